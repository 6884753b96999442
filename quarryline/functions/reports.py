"""Column expressions over scan reports: severity, gates, banners, keys, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that results contain.
BANNER = "🚨 **CRITICAL SECURITY VIOLATION:** Hardcoded secrets/passwords were detected and successfully redacted before AI analysis to prevent data leakage. \n\n"
NOT_READY = "CRITICAL FAIL (AUDIT BLOCKED)"
AT_RISK = "AT RISK (REMEDIATION REQUIRED)"
READY = "READY"

NO_NAME = "unknown.py"
NO_REPORT, NO_FIX = "Analysis unavailable.", "Error generating fix."
COMMENT = """
🚨 **{product} Automated Review** 🚨

We detected a **{severity}** severity vulnerability in this Pull Request.

**Vulnerability Analysis:**
{report}...

✅ **Self-Healing Code Fix Generated:**
```python
{fix}
```

*Please review the generated secure code above and commit the changes to proceed.*
    """

WEBHOOK_CHARS, COMMENT_CHARS, SECRET_CHARS = 1500, 500, 72


def severity_of_report(text: Column) -> Column:
    """Critical, High, Medium or Low by the first substring that the lower-cased text has, low as a word; else null."""
    low = F.lower(text)
    return F.when(low.contains("critical"), "Critical").when(low.contains("high"), "High").when(low.contains("medium"), "Medium").when(low.rlike(r"(?U)\blow\b"), "Low")


def gate_severity(report: Column, secrets: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM or LOW for a gate: upper-case words only; secrets are critical; LOW is the default."""
    return F.when(report.contains("CRITICAL") | secrets, "CRITICAL").when(report.contains("HIGH"), "HIGH").when(report.contains("MEDIUM"), "MEDIUM").otherwise("LOW")


def vulnerabilities_found(report: Column, secrets: Column) -> Column:
    """Whether the gate closes. MEDIUM alone does not close it."""
    return F.coalesce(F.lower(report).contains("vulnerabilities") | secrets | report.contains("CRITICAL") | report.contains("HIGH"), F.lit(False))


def with_banner(report: Column, secrets: Column, banner: str = BANNER) -> Column:
    """The banner before the report if there were secrets and it is not there already."""
    return F.when(secrets & ~report.contains(banner), F.concat(F.lit(banner), report)).otherwise(report)


def cache_key(code: Column, prompt: Column) -> Column:
    """SHA-256 of code, underscore, prompt. The separator is ambiguous by definition."""
    return F.sha2(F.concat(code, F.lit("_"), prompt), 256)


def tokens(text: Column) -> Column:
    """Search tokens: runs of letters and digits of three characters or more, lower-cased after that."""
    return F.transform(runs(text), lambda w: F.lower(w))


def runs(text: Column) -> Column:
    """The search tokens before they are lower-cased."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))


def latin1(text: Column) -> Column:
    """Each character beyond Latin-1 becomes a question mark."""
    return F.regexp_replace(text, r"[^\x{0}-\x{FF}]", "?")


def file_id(filename: Column) -> Column:
    return F.md5(filename)


def readiness(score: Column) -> Column:
    return F.when(score < 50, NOT_READY).when(score < 80, AT_RISK).otherwise(READY)


def iso_time(ts: Column, suffix: str = "") -> Column:
    """ISO 8601; microseconds only where there are any."""
    return F.concat(F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit(suffix))


def context_text(files: Column) -> Column:
    """An array of (filename, content) as one text for a prompt."""
    return F.array_join(F.transform(files, lambda f: F.concat(F.lit("--- File: "), f["filename"], F.lit(" ---\n"), f["content"])), "\n")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters, and one more for each beyond the basic plane."""
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def patch_range(line: Column, original: Column) -> Column:
    """(start, end) of a patch in UTF-16 units; a text that is not found starts at 0."""
    at = F.position(original, line)
    start = F.when(at > 0, utf16_length(F.substring(line, F.lit(1), at - 1))).otherwise(0)
    return F.struct(start.alias("start"), (start + utf16_length(original)).alias("end"))


def key_list(text: Column) -> Column:
    """A comma-separated list: trimmed, empty entries dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def is_rate_limit(error: Column) -> Column:
    return error.contains("429") | F.lower(error).contains("rate limit")


def stripped(text: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^\\/]*$", 0)


def is_blank(text: Column) -> Column:
    return stripped(text) == ""


def derived_id(seed: Column, prefix: str, digits: int) -> Column:
    """A reproducible stand-in for random ids: prefix and hex digits of a hash of the seed."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(seed.cast("string"), 256), 1, digits))


def webhook_payload(report: Column) -> Column:
    return F.substring(report, 1, WEBHOOK_CHARS)


def build_failed(code: Column, found: Column) -> Column:
    """Whether a build stops: the service did not answer with 200, or it found vulnerabilities; an answer without the flag stops nothing."""
    return (code != 200) | F.coalesce(found, F.lit(False))


def hashable(secret: Column) -> Column:
    """The characters of a password that its hash takes in."""
    return F.substring(secret, 1, SECRET_CHARS)


def review_comment(severity: Column, report: Column, fix: Column, product: str = "Code") -> Column:
    """The text that a pull request gets: COMMENT with the severity, the first characters of the report, and the fix."""
    values = {"product": F.lit(product), "severity": F.coalesce(severity, F.lit("None")), "report": F.substring(F.coalesce(report, F.lit(NO_REPORT)), 1, COMMENT_CHARS), "fix": F.coalesce(fix, F.lit(NO_FIX))}
    parts = re.split(r"\{(\w+)\}", COMMENT)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def fixed_1(value: Column) -> Column:
    """One decimal, rounded half up from the exact binary value; for values from 0 up to 127.

    The double times 2^52 is a whole number, so the rest is exact arithmetic on decimals.
    """
    whole = F.floor(value * F.lit(float(1 << 52))).cast("decimal(20,0)")
    twice, unit = whole * 20 + F.lit(1 << 52).cast("decimal(20,0)"), F.lit(1 << 53).cast("decimal(20,0)")
    tenths = ((twice - twice % unit) / unit).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
