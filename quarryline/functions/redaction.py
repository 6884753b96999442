"""Secret redaction as column expressions: three ordered patterns, all in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "[REDACTED]"

# What counts as a secret.
# (?iuU) gives case folding and white space the Unicode meaning. Two letters that fold to ASCII only one way
# (the Kelvin sign and the dotted capital I) and the four information separators are added by hand.
CLOUD_KEY = r"(?iuU)AKIA[0-9A-Z\x{212A}\x{0130}]{16}"
PAYMENT_KEY = r"(?iuU)sk_live_[0-9a-zA-Z\x{212A}\x{0130}]{24,}"
GENERIC = r"""(?iuU)(?:password|secret|api_key|token|auth)[\s\x1c-\x1f=:]+['"]([^'"]+)['"]"""


def _mask_generic(text: Column, mask: str) -> Column:
    """In each match every occurrence of the captured value is masked, keyword included; all else stays.

    The text is split at the matches and put together again, because a
    replacement pattern cannot replace within its match.
    """
    matches = F.regexp_extract_all(text, F.lit(GENERIC), F.lit(0))
    masked = F.transform(matches, lambda m: F.replace(m, F.regexp_extract(m, GENERIC, 1), F.lit(mask)))
    pieces = F.zip_with(F.split(text, GENERIC, -1), F.concat(masked, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(_generic_found(text), F.array_join(pieces, "")).otherwise(text)


def _generic_found(text: Column) -> Column:
    """Whether the generic pattern occurs; it ends in a quote, so a text without any is not searched."""
    return (text.contains("'") | text.contains('"')) & text.rlike(GENERIC)


def _keys_masked(text: Column, mask: str) -> Column:
    """The text after the first two patterns; ``redact`` and ``secrets_found`` share it, so it is worked out once."""
    literal = mask.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(F.regexp_replace(text, CLOUD_KEY, literal), PAYMENT_KEY, literal)


def redact(text: Column, mask: str = MASK) -> Column:
    """The text with all secrets masked; null stays null."""
    return _mask_generic(_keys_masked(text, mask), mask)


def secrets_found(text: Column, mask: str = MASK) -> Column:
    """Whether any pattern occurs, each looked for in the text as the ones before left it. The mask itself is no key, so a masked text differs."""
    masked = _keys_masked(text, mask)
    return F.coalesce((masked != text) | _generic_found(masked), F.lit(False))
