"""Quarryline: a PySpark-native analytics engine for code-security data.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and sinks), ``streaming`` (Structured
Streaming forms), ``plans`` (the query catalogue). ``llm`` holds training-data
operators and is optional: nothing here imports it.
"""
