"""Predicates on text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from . import text as T

# The patterns that decide what a line is. They must be these for the results to be right.
MASK = r"(?i:(?:^|(?<=[^\p{L}\p{N}_]))(?:ZXQNT" + T.SPACE + r"*\p{Nd}+(?:" + T.SPACE + r"*QXZ)?|OLPRO[\p{L}\p{N}_]*" + T.SPACE + r"*\p{Nd}+)(?![\p{L}\p{N}_]))"
SYMBOL = r"[=∑∫√≤≥≈≠∞∂∆∇±×÷→←↔⇒⇔^_{}<>|]"
EQUATION_NUMBER = r"(?:^| )\(\p{Nd}+(?:\.\p{Nd}+)*\) *$"
MATH_FUNCTION = r"(?:^|[^\p{L}\p{N}_])(?:sin|cos|tan|log|ln|lim|max|min|argmax|argmin|exp|sqrt|var|cov|Pr) *(?:\(|_)"
LATIN_WORD = r"^[A-Za-zÀ-ÖØ-öø-ÿ]{3,}$"
REFERENCE_HEADING = r"(?i)^(?:references|bibliography|literature(?: cited)?|works cited) *:? *$"
_END = r"(?:$|[^\p{L}\p{N}_])"
MEASURE = r"(?:^|[^\p{L}\p{N}_])\p{Nd}+(?:\.\p{Nd}+)? *(?:(?:mg|kg|mL|m2)(?:$|[^\p{L}\p{N}_])|m²(?:$|[^\p{L}\p{N}_])|%[\p{L}\p{N}_])"


def native_text(c: Column) -> Column:
    """Worth translating: two letters at least, and more letters than digits."""
    counts = lambda s: F.struct(F.length(s).alias("n"), T.letters(s).alias("l"), T.digits(s).alias("d"))
    return T.let(T.let(T.strip(c), counts), lambda x: (x["n"] >= 2) & (x["l"] >= 2) & ~((x["d"] > 0) & (x["l"] <= x["d"])))


def html_text(c: Column) -> Column:
    """Worth translating in HTML: not blank, an entity, a number or very short."""
    entity = r"^&(?:[\p{L}\p{N}_]+|#\p{Nd}+);$"
    return T.let(T.strip(c), lambda s: (F.length(s) >= 3) & (T.letters(s) >= 2) & ~s.rlike(entity) & ~F.regexp_replace(s, "[.,-]", "").rlike(f"^{T.DIGIT}+$"))


def has_mask(c: Column) -> Column:
    return c.rlike(MASK)


def unmasked_text(c: Column) -> Column:
    """Two letters at least besides the masks."""
    return T.letters(F.regexp_replace(c, MASK, " ")) >= 2


def contact_identity(c: Column) -> Column:
    """A mask among two to eight words, of which all but label words start with a capital."""
    found = F.regexp_extract_all(F.regexp_replace(c, MASK, " "), F.lit(r"\p{L}+(?:[-']\p{L}+)?"), F.lit(0))
    named = lambda f: F.forall(f, lambda w: F.lower(w).isin(*fixed.CONTACT_WORDS) | w.rlike(r"^\p{Lu}"))
    return has_mask(c) & T.let(found, lambda f: F.size(f).between(2, 8) & named(f))


def table_row(c: Column) -> Column:
    """A tab in the text after its bullet, or a number with a unit."""
    tabbed = lambda body: F.contains(body, F.lit("\t")) & (T.strip(body) != "")
    return T.let(T.without_bullet(c), lambda body: tabbed(body) | (body.rlike(r"\p{Nd}") & T.collapse(body).rlike(MEASURE)))


def flat_reference_line(s: Column) -> Column:
    """reference_line of a text whose white space is collapsed."""
    dated = s.rlike(r"\(\p{Nd}{4}[a-z]?\)") & F.lower(s).rlike(r"(?:^|[^\p{L}\p{N}_])(?:https?://|doi[: ])")
    return s.rlike(r"^\[\p{Nd}+\]") | s.rlike(r"^\p{Nd}+\. +[A-Z]") | (F.contains(s, F.lit("(")) & dated)


def reference_line(c: Column) -> Column:
    return T.let(T.collapse(c), flat_reference_line)


def reference_heading(c: Column) -> Column:
    return T.collapse(c).rlike(REFERENCE_HEADING)


def starts_structure(c: Column) -> Column:
    heading = r"(?i)^(?:(?:figure|table|abstract|keywords|references)" + _END + r"|fig\.[\p{L}\p{N}_])"
    return T.let(T.lstrip(c), lambda s: T.is_bullet(s) | s.rlike(heading) | s.rlike(r"^\p{Nd}+(?:\.\p{Nd}+)*" + T.SPACE + r"+[A-Z]"))


def sentence_boundary(before: Column, after: Column) -> Column:
    return T.rstrip(before).rlike(r"[.!?;]$") & T.lstrip(after).rlike(r"^\p{Lu}")


def flat_header_or_footer(s: Column) -> Column:
    """header_or_footer of a text whose white space is collapsed."""
    page = r"(?:^|[^\p{L}\p{N}_])page +\p{Nd}+" + _END
    doi = T.let(F.lower(s), lambda low: F.contains(low, F.lit("doi")) & low.rlike(r"(?:^|[^\p{L}\p{N}_])doi[: ]"))
    return F.startswith(s, F.lit("http")) | ((F.length(s) <= 18) & F.lower(s).rlike(page)) | s.rlike(r"^\p{Nd}+$") | doi


def header_or_footer(c: Column) -> Column:
    return T.let(T.collapse(c), flat_header_or_footer)


def not_sampled(c: Column, kind: Column) -> Column:
    """Text (white space collapsed) that says little about its language."""

    def rule(t: Column) -> Column:
        web = F.contains(t, F.lit("@")) | F.contains(F.lower(t), F.lit("http"))
        numbers = T.let(F.struct(T.letters(t).alias("n"), T.digits(t).alias("d")), lambda x: (x["n"] < 12) | ((x["d"] > 0) & (x["d"] >= F.greatest(F.lit(3.0), x["n"] * 0.35))))
        loud = T.times(t, T.UPPER) >= F.greatest(F.lit(10), F.floor(F.length(t) * 0.55))
        return F.endswith(t, F.lit(":")) | web | numbers | loud | flat_header_or_footer(t)

    return kind.isin(*fixed.NOT_SAMPLED_KINDS) | T.let(c, rule)


def noisy_sample(c: Column) -> Column:
    """Text (white space collapsed) that is no use for detecting a language in HTML.

    The share of digits is one of whole numbers: 180 * 0.35 as doubles is less than 63.
    """

    def rule(t: Column) -> Column:
        web = F.lower(t).rlike(r"(?:^|[^\p{L}\p{N}_])(?:https?://|www\.)|@")
        return (F.length(t) < 24) | web | T.let(T.letters(t), lambda n: (n < 12) | (T.digits(t) >= F.greatest(F.lit(4), F.floor(n * 35 / 100))))

    return T.let(c, rule)


def formula_line(c: Column) -> Column:
    """A line (white space collapsed) that is mostly mathematics."""

    def rule(x: Column) -> Column:
        s, sym, d = x["s"], x["sym"], x["d"]
        named = F.size(F.filter(T.tokens(s), lambda w: w.rlike(LATIN_WORD)))
        dense = (sym + d) / F.length(F.regexp_replace(s, T.SPACE, "")) >= 0.35
        return (F.length(s) >= 3) & (
            (sym >= 3)
            | (((sym >= 1) | (d >= 2)) & s.rlike(EQUATION_NUMBER))
            | (((sym >= 1) | (d >= 1)) & s.rlike(MATH_FUNCTION))
            | ((sym >= 1) & dense & (named <= 3))
            | ((sym >= 2) & (T.letters(s) <= d + sym) & (named <= 4))
        )

    counts = lambda s: F.struct(s.alias("s"), T.times(s, SYMBOL).alias("sym"), T.digits(s).alias("d"))
    return T.let(T.let(T.strip(c), counts), rule)


def word_hyphen_end(c: Column) -> Column:
    return T.rstrip(c).rlike(r"\p{L}-$")


def degenerate(src: Column, dst: Column) -> Column:
    """Runaway length, few distinct words, or four words in a row three times."""

    def repeats(w: Column) -> Column:
        n = F.size(w)
        grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, 4))))
        thrice = T.let(grams, lambda g: F.exists(F.sequence(F.lit(2), F.greatest(F.size(g) - 1, F.lit(2))), lambda i: F.get(g, i - 2) == F.get(g, i)))
        return (n >= 16) & ((F.size(F.array_distinct(w)) / n < 0.4) | thrice)

    return (F.length(dst) > F.greatest(F.length(src) * 2.4, F.length(src) + 120.0)) | T.let(T.words(dst), repeats)


def english_left(dst: Column) -> Column:
    """Many English stopwords among ten tokens at least."""
    found = F.regexp_extract_all(dst, F.lit("[a-zA-Z']+"), F.lit(0))
    both = lambda f: F.struct(F.size(f).alias("n"), F.size(F.filter(f, lambda t: t.isin(*fixed.STOPWORDS))).alias("hits"))
    return T.let(T.let(found, both), lambda x: (x["n"] >= 10) & (x["hits"] >= 6) & (x["hits"] / x["n"] >= 0.22))
