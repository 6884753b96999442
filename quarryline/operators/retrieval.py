"""Term index over files and top-k retrieval by term frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.reports import NO_NAME, context_text, file_id, runs, tokens
from quarryline.names import fresh


def latest_files(files: DataFrame) -> DataFrame:
    """repo_id, file_id, filename, content, place: the last content of each file, in the place of its first.

    files: repo_id, filename, content, seq (anything that has an order). A null
    file name is that of ``sources.tables.ingest_requests`` for a missing one,
    and null content is empty. ``seq`` differs between the rows of a file.
    """
    named = files.withColumns({"filename": F.coalesce("filename", F.lit(NO_NAME)), "content": F.coalesce("content", F.lit(""))}).withColumn("file_id", file_id(F.col("filename")))
    # contents stay out of the aggregate: the narrow rows that it gives are built into a hash table, and each content passes it once
    last = named.groupBy("repo_id", "file_id").agg(F.max("seq").alias("last"), F.min("seq").alias("place")).withColumnRenamed("repo_id", "repo")
    same = F.col("repo_id").eqNullSafe(F.col("repo")) & (F.col("id") == F.col("file_id")) & (F.col("last") == F.col("seq"))
    return named.withColumnRenamed("file_id", "id").join(last.hint("shuffle_hash"), same).select("repo_id", "file_id", "filename", "content", "place")


def term_counts(files: DataFrame, *keys: str, text: Column | str = "content") -> DataFrame:
    """keys, token, n, total for each distinct token of each row."""
    text = F.col(text) if isinstance(text, str) else text
    s, at, k, i = (fresh(x, files.select(*keys)) for x in ("sorted", "starts", "k", "i"))
    # counted within the row: the sorted tokens are cut where they change
    ordered = files.select(*keys, F.sort_array(tokens(text)).alias(s))
    places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1))
    starts = ordered.select(*keys, s, F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))).alias(at))
    # an inner explode, or a filter on the arrays, would be repeated below with the tokens of each row, and there for each place
    each = starts.select(*keys, s, at, F.posexplode_outer(at).alias(k, i)).where(F.col(i).isNotNull())
    end = F.coalesce(F.get(at, F.col(k) + 1), F.size(s))
    return each.select(*keys, F.get(s, F.col(i)).alias("token"), (end - F.col(i)).cast("long").alias("n"), F.size(s).cast("long").alias("total"))


def occurrences(files: DataFrame, *keys: str, text: Column | str = "content") -> DataFrame:
    """keys, token, n (1), total for each token of each row as often as it occurs: for ``scores``, which drops all but the queries' tokens at once."""
    text = F.col(text) if isinstance(text, str) else text
    found = fresh("found", files.select(*keys))
    each = files.select(*keys, runs(text).alias(found)).select(*keys, F.size(found).cast("long").alias("total"), F.explode(found).alias("token"))
    return each.select(*keys, F.lower("token").alias("token"), F.lit(1).cast("long").alias("n"), "total")  # lower-cased in generated code


def query_counts(queries: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, qn: how often each query has each token."""
    return queries.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("qn"))


def scores(index: DataFrame, queries: DataFrame, key: str, *file_keys: str) -> DataFrame:
    """key, file_keys, score: the query's tokens, with multiplicity, times the term frequencies (of ``term_counts`` or ``occurrences``).

    The sum is over whole numbers and divided once, so it does not depend on
    the order of the rows. Spark broadcasts the query side where its size lets
    it; then nothing is shuffled but the matches' sums.
    """
    return index.join(queries, "token").groupBy(key, *file_keys).agg((F.sum(F.col("qn") * F.col("n")) / F.first("total")).alias("score"))


def top_k(scored: DataFrame, key: str, place: str, k: int) -> DataFrame:
    """The k best of each query; ties keep the order of ``place``. Scores of 0 never match."""
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(place))
    return scored.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def retrieve(files: DataFrame, queries: DataFrame, *, repo: str, key: str = "query_id", text: str = "code", k: int = 3) -> DataFrame:
    """key, rank, filename, content, score: the context files of each query from one repository."""
    stored = latest_files(files.where(F.col("repo_id") == repo))
    found = top_k(scores(occurrences(stored, "file_id", "place"), query_counts(queries, key, text), key, "file_id", "place"), key, "place", k)
    return found.join(stored.select("file_id", "filename", "content"), "file_id").select(key, "rank", "filename", "content", "score")


def context(found: DataFrame, key: str = "query_id") -> DataFrame:
    """key, context: the retrieved files as one text, best first; k files at most come together."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "filename", "content")))
    return found.groupBy(key).agg(context_text(ranked).alias("context"))
