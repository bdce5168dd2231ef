"""Masking of text that must not change: addresses, links and handles become numbered tokens and come back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from . import text as T

# The patterns of what is masked.
EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_STOP = r"[^\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}<>()\"']"
URL = r"https?://" + _STOP + r"+|www\." + _STOP + "+"
HANDLE = r"(?<![\p{L}\p{N}_.@])@[A-Za-z0-9_]{2,30}(?![\p{L}\p{N}_])"
PROTECTED = f"{EMAIL}|{URL}|{HANDLE}"


def mask(c: Column, pattern: str = PROTECTED) -> Column:
    """struct<masked string, replacements array<string>>; punctuation at a link's end stays outside of its token."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    link = lambda v: ~v.rlike(f"^(?:{EMAIL})$") & v.rlike("^(?:https?://|www[.])")
    tail = r"""[.,;:!?)\]}"']+$"""
    kept = F.transform(found, lambda v: F.when(link(v), F.regexp_replace(v, tail, "")).otherwise(v))
    after = F.zip_with(found, kept, lambda v, k: F.substring(v, F.length(k) + 1, F.length(v)))
    tokens = F.transform(after, lambda a, i: F.concat(F.lit(fixed.MASK_PREFIX), i.cast("string"), F.lit(fixed.MASK_SUFFIX), a))
    between = F.split(c, pattern, -1)
    masked = F.concat_ws("", F.zip_with(between, tokens, lambda b, t: F.concat(b, F.coalesce(t, F.lit("")))))
    full = F.struct(masked.alias("masked"), kept.alias("replacements"))
    # Most text holds none of the marks without which nothing is masked; looking for these is far cheaper than the pattern.
    marks = F.contains(c, F.lit("@")) | F.contains(c, F.lit("://")) | F.contains(c, F.lit("www."))
    return F.when(c.isNull(), None).when(marks, full).otherwise(F.struct(c.alias("masked"), F.array().cast("array<string>").alias("replacements")))


def unmask(c: Column, replacements: Column) -> Column:
    """The text with its tokens replaced, also spaced, cut short or legacy ones, in any case."""
    quoted = F.transform(replacements, lambda v, i: F.struct(i.cast("string").alias("i"), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")).alias("v")))

    def step(acc: Column, x: Column) -> Column:
        own = F.concat(F.lit(rf"(?iU)\b{fixed.MASK_PREFIX}\s*"), x["i"], F.lit(rf"(?:\s*{fixed.MASK_SUFFIX})?\b"))
        legacy = F.concat(F.lit(r"(?iU)\bOLPRO\w*\s*"), x["i"], F.lit(r"\b"))
        return F.regexp_replace(F.regexp_replace(acc, own, x["v"]), legacy, x["v"])

    return F.aggregate(quoted, c, step)
