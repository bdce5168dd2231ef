"""Secret scan: patterns, and sliding-window entropy of candidate strings. DataFrame functions only.

Base kinds are patterns. Beyond them, candidates are long unbroken strings of key-like characters that hold a digit and that no
base span touches. Each candidate belongs to the narrowest character class that holds it; a window slides over it, and the
window's Shannon entropy is kept up to date from incremental counts: with c equal characters among W, the entropy is
log2(W) - sum(c * log2(c)) / W, so a step changes two terms. The span from the first to the last window at or above the class's
threshold is a finding, unless the candidate matches the allow-list.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: kind: (pattern, group whose length counts, least length).
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Order of kinds at the same start.
KINDS = [*BASE, "entropy"]


@dataclass(frozen=True)
class EntropyRule:
    """What the entropy scan takes for a secret."""

    window: int = 20
    candidate: str = r"[A-Za-z0-9+/_=-]{20,}"
    #: (class, pattern of a whole candidate, least entropy in bits of a window), narrowest first.
    classes: tuple[tuple[str, str, float], ...] = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("alnum", r"^[0-9A-Za-z]+$", 3.6), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8))
    #: Candidates that match one of these are no secrets: UUIDs, paths and slugs of words, placeholders, counting sequences.
    #: Repeated groups must be possessive: Java matches others by recursion, and a long candidate would overflow its stack.
    allow: tuple[str, ...] = (
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
        r"^[a-z]++(?:[-_/][a-z]++)*+(?:[-_/][0-9]{1,8}+)*+$",
        r"(?i:example|placeholder|changeme|xxxx|dummy)",
        r"0123456789|9876543210",
        r"(?i:abcdefghij)",
    )
    alphabet: str = field(default="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


_SPAN = "struct<start:int,end:int,kind:string>"


def _none(element: str = _SPAN) -> Column:
    return F.array().cast(f"array<{element}>")


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once: the optimizer would copy its expression to each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """A non-empty array cut into about as many pieces as each then has elements."""

    def cut(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        pieces = F.floor((F.size(x) - 1) / width).cast("int")
        return F.transform(F.sequence(F.lit(0), pieces), lambda k: F.slice(x, k * width + 1, width))

    return _let(items, cut)


def scan(items: Column, start: Column, step, result, empty: Column) -> Column:
    """Array of what is left by going through items with a state: step(state, x) gives the next, result(state, x) an array to add.

    An array grows by being copied, so results are gathered in pieces and put together once: n elements take about n ** 1.5 copies
    of a reference at most, where appending to one array would take n ** 2.
    """

    def within(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], result(acc["state"], x)).alias("out"))

    def over(acc: Column, piece: Column) -> Column:
        inner = F.aggregate(piece, F.struct(acc["state"].alias("state"), empty.alias("out")), within)
        return _let(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    whole = F.struct(start.alias("state"), F.slice(F.array(empty), 1, 0).alias("out"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(_blocks(items), whole, over, lambda acc: acc["out"]))).otherwise(empty)


def pattern_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start int, end int, kind string>> of the leftmost non-overlapping matches whose group is long enough.

    Offsets are code points, end exclusive: they follow from the lengths of the matches and of what lies between them.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    sizes = F.zip_with(whole, part, lambda w, p: F.struct(F.length(w).alias("w"), F.length(p).alias("p")))
    pieces = _let(sizes, lambda m: F.zip_with(F.slice(between, 1, F.size(m)), m, lambda b, m: F.struct(b.alias("b"), m["w"].alias("w"), m["p"].alias("p"))))

    def span(at: Column, x: Column) -> Column:
        return F.when(x["p"] >= least, F.array(F.struct((at + x["b"]).alias("start"), (at + x["b"] + x["w"]).alias("end"), F.lit(kind).alias("kind")))).otherwise(_none())

    found = _let(pieces, lambda p: scan(p, F.lit(0), lambda at, x: at + x["b"] + x["w"], span, _none()))
    return F.when(text.rlike(pattern), found).otherwise(_none())


def _term(c: Column) -> Column:
    """c * log2(c), 0 for 0."""
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)


def entropy_span(value: Column, rule: EntropyRule) -> Column:
    """struct<first int, last int> of the first and last window start at or above the class's threshold; null if there is none.

    The counts of a window are the characters of a string, one for each character of the candidate's class: a step replaces two.
    """
    w = rule.window
    known = F.lit(None).cast("struct<letters:string,most:double>")
    for _, pattern, least in reversed(rule.classes):
        letters = "".join(c for c in rule.alphabet if re.search(pattern, c))
        known = F.when(value.rlike(pattern), F.struct(F.lit(letters).alias("letters"), F.lit((math.log2(w) - least) * w).alias("most"))).otherwise(known)
    base = ord("0")  # the character of a count of 0
    start = F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("counts"), F.lit(0.0).cast("double").alias("terms"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def take(acc: Column, c: Column, old: Column, letters: Column, most: Column) -> Column:
        def counted(counts: Column, k: Column) -> Column:
            return F.ascii(F.substring(counts, k, F.lit(1))) - base

        def entered(x: Column) -> Column:
            # A character that leaves as the same one enters changes nothing.
            gain = F.when(old == c, 0.0).otherwise(_term(x["had"] + 1) - _term(x["had"]))
            drop = F.when((old > 0) & (old != c), _term(x["lost"]) - _term(x["lost"] - 1)).otherwise(0.0)
            more = F.when(old == c, x["counts"]).otherwise(F.overlay(x["counts"], F.char(x["had"] + 1 + base), c, F.lit(1)))
            fewer = F.when((old > 0) & (old != c), F.overlay(more, F.char(x["lost"] - 1 + base), old, F.lit(1))).otherwise(more)
            return F.struct((acc["i"] + 1).alias("i"), fewer.alias("counts"), (acc["terms"] + gain - drop).alias("terms"))

        def marked(x: Column) -> Column:
            high = (x["i"] >= w) & (x["terms"] <= most + 1e-9)
            return F.struct(x["i"].alias("i"), x["counts"].alias("counts"), x["terms"].alias("terms"), F.when(acc["first"].isNull() & high, x["i"] - w).otherwise(acc["first"]).alias("first"), F.when(high, x["i"] - w).otherwise(acc["last"]).alias("last"))

        counts = F.coalesce(acc["counts"], F.repeat(F.lit(chr(base)), F.length(letters)))
        now = _let(counts, lambda n: F.struct(n.alias("counts"), counted(n, c).alias("had"), counted(n, F.greatest(old, F.lit(1))).alias("lost")))
        return _let(_let(now, entered), marked)

    def of(known: Column) -> Column:
        codes = F.transform(F.split(value, ""), lambda ch: F.instr(known["letters"], ch))
        return _let(codes, lambda codes: F.aggregate(
            F.zip_with(codes, F.concat(F.array_repeat(F.lit(0), w), F.slice(codes, 1, F.greatest(F.size(codes) - w, F.lit(0)))), lambda c, old: F.struct(c.alias("c"), old.alias("old"))),
            start, lambda acc, x: take(acc, x["c"], x["old"], known["letters"], known["most"]), lambda acc: F.when(acc["first"].isNotNull(), F.struct(acc["first"].alias("first"), acc["last"].alias("last"))),
        ))

    return _let(known, of)


def _untouched(found: Column, base: Column) -> Column:
    """The candidates (s, v), in order, that no base span overlaps; one sweep over both."""
    ends = F.transform(found, lambda x: F.struct(x["s"]["end"].alias("at"), F.lit(0).alias("base"), F.lit(0).alias("end")))
    begins = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("end")))
    # Where a candidate ends, the farthest end of the base spans that have begun says whether one reaches into it.
    reach = _let(F.array_sort(F.concat(ends, begins)), lambda e: scan(e, F.lit(0), lambda far, x: F.greatest(far, x["end"]), lambda far, x: F.when(x["base"] == 0, F.array(far)).otherwise(_none("int")), _none("int")))
    free = F.filter(F.zip_with(found, reach, lambda x, far: F.struct(x.alias("x"), far.alias("far"))), lambda z: z["far"] <= z["x"]["s"]["start"])
    return F.when((F.size(base) > 0) & (F.size(found) > 0), F.transform(free, lambda z: z["x"])).otherwise(found)


def _entropy_spans(text: Column, base: Column, rule: EntropyRule) -> Column:
    spans = pattern_spans(text, "entropy", rule.candidate, 0, rule.window)
    found = F.zip_with(spans, F.regexp_extract_all(text, F.lit(rule.candidate), F.lit(0)), lambda s, v: F.struct(s.alias("s"), v.alias("v")))
    allowed = lambda v: v.rlike("|".join(f"(?:{a})" for a in rule.allow)) if rule.allow else F.lit(False)
    found = F.filter(found, lambda x: x["v"].rlike("[0-9]") & ~allowed(x["v"]))
    free = _let(found, lambda f: _untouched(f, base))
    scored = F.transform(free, lambda x: F.struct(x["s"]["start"].alias("start"), entropy_span(x["v"], rule).alias("e")))
    kept = F.filter(scored, lambda x: x["e"].isNotNull())
    spans = F.transform(kept, lambda x: F.struct((x["start"] + x["e"]["first"]).alias("start"), (x["start"] + x["e"]["last"] + rule.window).alias("end"), F.lit("entropy").alias("kind")))
    return F.when(text.rlike(rule.candidate), spans).otherwise(_none())


def _sorted(spans: Column) -> Column:
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def scan_secrets(docs: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """(doc_id, base, spans) for every document row: arrays of struct<start, end, kind>, by start, then kind in the order KINDS.

    base are the pattern kinds' spans (whole matches), spans these and the entropy scan's. A null text counts as empty, and empty
    texts have no spans; a null or repeated doc_id is a row like any other; an empty table gives no rows; other columns are
    ignored.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    base = F.concat(*[pattern_spans(F.col("text"), k, *rest) for k, rest in BASE.items()])
    d = d.withColumn("base", _sorted(base))
    return d.select("doc_id", "base", _sorted(F.concat("base", _entropy_spans(F.col("text"), F.col("base"), rule))).alias("spans"))


def joined(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rule: EntropyRule = EntropyRule(), mark: str = "[secret]") -> DataFrame:
    """The documents with every span of scan_secrets replaced by mark; columns as in docs.

    Spans that overlap give one mark. A null text stays null, a text without spans as it is; a null or repeated doc_id is a row
    like any other.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("__base", _sorted(F.concat(*[pattern_spans(text, k, *rest) for k, rest in BASE.items()])))
    d = d.withColumn("__spans", _sorted(F.concat("__base", _entropy_spans(text, F.col("__base"), rule))))

    def cut(piece: Column, origin: Column, spans: Column) -> Column:
        """What lies before each of the spans, with a mark, in a piece of the text that begins at origin and ends with them."""

        def within(acc: Column, s: Column) -> Column:
            before = F.substring(piece, acc["at"] - origin + 1, s["start"] - acc["at"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.array(before, F.lit(mark))).otherwise(_none("string"))).alias("out"))

        return F.aggregate(spans, F.struct(origin.alias("at"), _none("string").alias("out")), within, lambda acc: F.array_join(acc["out"], ""))

    def over(acc: Column, spans: Column) -> Column:
        # The text is cut piece by piece, as finding a place in it means walking to it. A span that began in the piece before is done.
        ahead = F.filter(spans, lambda s: s["start"] >= acc["at"])
        end = F.greatest(acc["at"], F.array_max(F.transform(spans, lambda s: s["end"])))
        return _let(end, lambda end: F.struct(
            end.alias("at"), F.substring(acc["rest"], end - acc["at"] + 1, F.length(acc["rest"])).alias("rest"),
            F.concat(acc["out"], F.array(cut(F.substring(acc["rest"], F.lit(1), end - acc["at"]), acc["at"], ahead))).alias("out"),
        ))

    start = F.struct(F.lit(0).alias("at"), text.alias("rest"), _none("string").alias("out"))
    whole = F.aggregate(_blocks(F.col("__spans")), start, over, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))
    return d.withColumn("text", F.when(F.col("text").isNotNull() & (F.size("__spans") > 0), whole).otherwise(F.col("text"))).select(docs.columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    d = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return d.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _sql_base(kind: str) -> str:
    pattern, group, least = BASE[kind]
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS rank, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'w': length(m[i]), 'p': length(p[i])}})) AS x
    FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS b, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS p FROM d WHERE regexp_matches(text, '{pattern}'))"""


def _sql(rule: EntropyRule = EntropyRule()) -> str:
    w = rule.window
    threshold = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN {t}" for _, p, t in rule.classes) + " END"
    allow = "|".join(f"(?:{re.sub(r'(?<=[+*}])[+]', '', a)})" for a in rule.allow)  # the other engine never goes back
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(_sql_base(k) for k in BASE)}),
base AS (
  SELECT doc_id, kind, rank, x.s::BIGINT AS s, (x.s + x.w)::BIGINT AS e FROM raw
  WHERE x.p >= CASE kind {" ".join(f"WHEN '{k}' THEN {n}" for k, (_, _, n) in BASE.items())} END
), cand AS (
  SELECT doc_id, x.s::BIGINT AS s, x.v AS v FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'v': m[i]}})) AS x
    FROM (SELECT doc_id, string_split_regex(text, '{rule.candidate}') AS b, regexp_extract_all(text, '{rule.candidate}') AS m FROM d WHERE regexp_matches(text, '{rule.candidate}')))
), free AS (
  SELECT *, row_number() OVER () AS c, {threshold} AS least FROM cand
  WHERE regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '{allow}')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = cand.doc_id AND b.s < cand.s + length(cand.v) AND cand.s < b.e)
), windows AS (
  SELECT doc_id, c, s, least, k, string_split(substring(v, k + 1, {w}), '') AS chars FROM (SELECT *, unnest(range(length(v) - {w - 1})) AS k FROM free)
), terms AS (
  SELECT c, k, any_value(doc_id) AS doc_id, any_value(s) AS s, any_value(least) AS least, sum(n * log2(n)) AS t
  FROM (SELECT doc_id, c, s, least, k, ch, count(*) AS n FROM (SELECT *, unnest(chars) AS ch FROM windows) GROUP BY ALL) GROUP BY c, k
), added AS (
  SELECT doc_id, 'entropy' AS kind, {KINDS.index("entropy")} AS rank, (s + min(k))::BIGINT AS s, (s + max(k) + {w})::BIGINT AS e
  FROM terms WHERE t <= (log2({w}) - least) * {w} + 1e-9 GROUP BY doc_id, c, s
), per_base AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS t FROM base GROUP BY doc_id
), per_all AS (
  SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS t FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(per_base.t, '')) AS base_sha256, coalesce(per_all.t, '') AS spans
FROM d LEFT JOIN per_base USING (doc_id) LEFT JOIN per_all USING (doc_id)
"""


OP9_SQL = _sql()
