"""Pieces of SQL for DuckDB, the counterparts of functions.text and functions.predicates."""

from __future__ import annotations

from ..functions import fixed
from ..functions import predicates as P
from ..functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(c: str, values) -> str:
    return f"{c} IN ({', '.join(map(lit, values))})"


def sub(c: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(new)}, 'g')"


def like(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)})"


def strip(c: str) -> str:
    return sub(c, f"^{T.SPACE}+|{T.SPACE}+$")


def lstrip(c: str) -> str:
    return sub(c, f"^{T.SPACE}+")


def rstrip(c: str) -> str:
    return sub(c, f"{T.SPACE}+$")


def collapse(c: str) -> str:
    return f"trim({sub(c, T.SPACE + '+', ' ')}, ' ')"


def times(c: str, pattern: str) -> str:
    return f"(length({c}) - length({sub(c, pattern)}))"


def letters(c: str) -> str:
    return times(c, T.LETTER)


def digits(c: str) -> str:
    return times(c, T.DIGIT)


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {lit(T.SPACE + '+')}), lambda w: w <> '')"


def tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {lit(T.NOT_WORD + '+')}), lambda w: w <> '')"


def native_text(c: str) -> str:
    s = strip(c)
    return f"(length({s}) >= 2 AND {letters(s)} >= 2 AND NOT ({digits(s)} > 0 AND {letters(s)} <= {digits(s)}))"


def table_row(c: str) -> str:
    body = sub(c, T.BULLET)
    return f"({collapse(body)} <> '' AND (contains({body}, chr(9)) OR {like(collapse(body), P.MEASURE)}))"


def reference_line(c: str) -> str:
    s = collapse(c)
    dated = like(s, r"\(\p{Nd}{4}[a-z]?\)") + " AND " + like(f"lower({s})", r"(?:^|[^\p{L}\p{N}_])(?:https?://|doi[: ])")
    return f"({like(s, r'^\[\p{Nd}+\]')} OR {like(s, r'^\p{Nd}+\. +[A-Z]')} OR ({dated}))"


def reference_heading(c: str) -> str:
    return like(collapse(c), P.REFERENCE_HEADING)


def starts_structure(c: str) -> str:
    s, end = lstrip(c), r"(?:$|[^\p{L}\p{N}_])"
    return f"({like(s, T.BULLET)} OR {like(s, '(?i)^(?:(?:figure|table|abstract|keywords|references)' + end + r'|fig\.[\p{L}\p{N}_])')} OR {like(s, r'^\p{Nd}+(?:\.\p{Nd}+)*' + T.SPACE + '+[A-Z]')})"


def sentence_boundary(a: str, b: str) -> str:
    return f"({like(rstrip(a), '[.!?;]$')} AND {like(lstrip(b), r'^\p{Lu}')})"


def header_or_footer(c: str) -> str:
    s = collapse(c)
    low, end = f"lower({s})", r"(?:$|[^\p{L}\p{N}_])"
    return f"((length({s}) <= 18 AND {like(low, r'(?:^|[^\p{L}\p{N}_])page +\p{Nd}+' + end)}) OR {like(s, r'^\p{Nd}+$')} OR {like(low, r'(?:^|[^\p{L}\p{N}_])doi[: ]')} OR starts_with({s}, 'http'))"


def formula_line(c: str) -> str:
    s = strip(c)
    sym, d, n = times(s, P.SYMBOL), digits(s), letters(s)
    named = f"len(list_filter({tokens(s)}, lambda w: {like('w', P.LATIN_WORD)}))"
    return (
        f"(length({s}) >= 3 AND (({like(s, P.EQUATION_NUMBER)} AND ({sym} >= 1 OR {d} >= 2)) OR ({like(s, P.MATH_FUNCTION)} AND ({sym} >= 1 OR {d} >= 1)) OR {sym} >= 3 "
        f"OR ({sym} >= 1 AND ({sym} + {d}) / length({sub(s, T.SPACE)}) >= 0.35 AND {named} <= 3) OR ({sym} >= 2 AND {n} <= {d} + {sym} AND {named} <= 4)))"
    )


def not_sampled(c: str, kind: str) -> str:
    n, d = letters(c), digits(c)
    return (
        f"({c} LIKE '%:' OR {among(kind, fixed.NOT_SAMPLED_KINDS)} OR {header_or_footer(c)} OR contains({c}, '@') OR contains(lower({c}), 'http') OR {n} < 12 "
        f"OR ({d} > 0 AND {d} >= greatest(3.0, {n} * 0.35)) OR {times(c, T.UPPER)} >= greatest(10, floor(length({c}) * 0.55)))"
    )


def join_hyphened(a: str, b: str) -> str:
    x, y = rstrip(a), lstrip(b)
    return f"(CASE WHEN {x} = '' THEN {y} WHEN {y} = '' THEN {x} WHEN {x} LIKE '%-' THEN left({x}, length({x}) - 1) || {y} ELSE {x} || ' ' || {y} END)"


def language_code(c: str) -> str:
    code = f"replace(lower({strip(c)}), '_', '-')"
    return f"(CASE WHEN {like(code, '^(?s:..-..)$')} THEN left({code}, 2) ELSE {code} END)"


def language_error(c: str) -> str:
    code = language_code(c)
    return f"(CASE WHEN {c} IS NULL THEN NULL WHEN NOT {like(code, r'^\p{L}\p{L}$')} THEN 'format' WHEN NOT {among(code, fixed.LANGUAGES)} THEN 'unknown' END)"


def engine(c: str) -> str:
    name = f"lower({strip(c)})"
    return f"(CASE WHEN {c} IS NULL OR {name} = '' THEN 'llm' WHEN {among(name, fixed.ENGINES)} THEN {name} END)"


def service_supports(c: str) -> str:
    code = language_code(c)
    return f"({among(code, fixed.LANGUAGES)} AND NOT {among(code, fixed.SERVICE_LACKS)})"


def suffix(c: str) -> str:
    return f"lower(regexp_extract(regexp_extract({c}, '([^/]*)/*$', 1), '^.+(\\.[^.]+)$', 1))"


def stem(c: str) -> str:
    base = f"regexp_extract({c}, '([^/]*)/*$', 1)"
    return f"(CASE WHEN {like(base, r'^.+\.[^.]+$')} THEN regexp_extract({base}, '^(.+)\\.[^.]+$', 1) ELSE {base} END)"


LINES = f"(SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split_regex(text, {lit(T.LINE_END)}) AS l FROM documents))"
