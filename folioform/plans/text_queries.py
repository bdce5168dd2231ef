"""Queries over lines, segments and other text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, masking
from ..functions import predicates as P
from ..functions import text as T
from ..operators import lines as L
from ..operators import qa
from ..sources import files, html
from . import sql as S
from .registry import query, table

_LINES = f"SELECT doc_id, line_no::INTEGER AS line_no, line FROM {S.LINES} WHERE {S.strip('line')} <> ''"


@query(f"""
WITH p AS (SELECT doc_id, (line_no // 40) AS page, {S.collapse("line")} AS line FROM ({_LINES})),
f AS (SELECT doc_id, page, count(*) AS n, sum(CASE WHEN {S.formula_line("line")} THEN 1 ELSE 0 END) AS k FROM p GROUP BY doc_id, page),
d AS (SELECT doc_id, count(*) AS pages, sum(n)::BIGINT AS lines, sum(k)::BIGINT AS formula_lines, (count(*) FILTER (k > 0))::BIGINT AS pages_with, max(k)::BIGINT AS max_on_page FROM f GROUP BY doc_id)
SELECT *, CASE WHEN formula_lines >= 12 AND formula_lines / lines >= 0.08 THEN 'formula_line_density'
  WHEN pages >= 3 AND formula_lines >= 8 AND pages_with / pages >= 0.25 THEN 'formula_spread_across_pages'
  WHEN formula_lines >= 12 AND max_on_page >= 8 THEN 'formula_dense_page' END AS reason FROM d
""")
def policy_verdict(spark: SparkSession, d: str) -> DataFrame:
    return L.formula_policy(L.pages(table(spark, d, "documents"))).drop("allowed")


# Lines with as many digits as doc_id and line_no ask for, so that the digit rule fires.
_NUMBERED = f"SELECT doc_id, line_no, CASE WHEN (doc_id + line_no) % 5 = 0 THEN repeat('7', ((doc_id + line_no) % 97)::INTEGER) || line ELSE line END AS line FROM ({_LINES})"


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") + F.col("line_no")
    return L.lines(table(spark, d, "documents")).withColumn("line", F.when(k % 5 == 0, F.concat(F.repeat(F.lit("7"), (k % 97).cast("int")), "line")).otherwise(F.col("line")))


@query(f"SELECT doc_id, line_no, {S.letters('line')} AS letters, {S.digits('line')} AS digits, {S.native_text('line')} AS ok FROM ({_NUMBERED})")
def native_text_filter(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return _numbered(spark, d).select("doc_id", "line_no", T.letters(line).cast("long").alias("letters"), T.digits(line).cast("long").alias("digits"), P.native_text(line).alias("ok"))


@query(f"SELECT doc_id, length({S.collapse('text')}) AS collapsed_len, sha256(lower({S.collapse('text')})) AS comparable, sha256({S.strip(S.sub('text', T.SPACE + '*' + chr(10) + '+' + T.SPACE + '*', ' '))}) AS one_line FROM documents")
def whitespace_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(T.collapse(t)).cast("long").alias("collapsed_len"), F.sha2(T.comparable(t), 256).alias("comparable"), F.sha2(T.one_line(t), 256).alias("one_line"))


_PADDED = "SELECT page_id, repeat(' ', (page_id % 4)::INTEGER) || regexp_extract(html, '<title>([^<]*)</title>', 1) || repeat(chr(10), (page_id % 3)::INTEGER) AS text FROM pages"


@query(f"""
SELECT page_id, length(regexp_extract(text, '^({T.SPACE}*)', 1)) AS prefix_len, {S.strip("text")} AS core,
  CASE WHEN {S.strip("text")} = '' THEN 0 ELSE length(regexp_extract(text, '({T.SPACE}*)$', 1)) END AS suffix_len,
  CASE WHEN {S.strip("text")} = '' THEN text ELSE replace(text, {S.strip("text")}, '<' || {S.strip("text")} || '>') END AS marked FROM ({_PADDED})
""")
def edge_whitespace(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    p = table(spark, d, "pages").select("page_id", F.concat(F.repeat(F.lit(" "), (k % 4).cast("int")), title, F.repeat(F.lit("\n"), (k % 3).cast("int"))).alias("text"))
    before, core, after = T.outer_space(F.col("text"))
    marked = F.when(core == "", F.col("text")).otherwise(T.replace_core(F.col("text"), F.concat(F.lit("<"), core, F.lit(">"))))
    return p.select("page_id", F.length(before).cast("long").alias("prefix_len"), core.alias("core"), F.length(after).cast("long").alias("suffix_len"), marked.alias("marked"))


_BROKEN = f"SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN line || '-' ELSE line END AS line FROM ({_LINES})"


@query(f"""
WITH p AS (SELECT doc_id, line_no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM ({_BROKEN}))
SELECT doc_id, line_no, {S.like(S.rstrip("line"), r"\p{L}-$")} AS breaks_word, sha256({S.join_hyphened("line", "nxt")}) AS joined FROM p WHERE nxt IS NOT NULL
""")
def dehyphen_join(spark: SparkSession, d: str) -> DataFrame:
    b = L.lines(table(spark, d, "documents")).withColumn("line", F.when(F.col("line_no") % 3 == 0, F.concat("line", F.lit("-"))).otherwise(F.col("line")))
    p = b.withColumn("nxt", F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))).where("nxt is not null")
    return p.select("doc_id", "line_no", P.word_hyphen_end(F.col("line")).alias("breaks_word"), F.sha2(T.join_hyphened(F.col("line"), F.col("nxt")), 256).alias("joined"))


_MARKS = ["- ", "•\t", "* ", "", "1. ", "· ", " ‣ ", "-"]


@query(f"""
SELECT doc_id, line_no, {S.like("t", T.BULLET)} AS is_bullet, sha256({S.sub("t", T.BULLET)}) AS body
FROM (SELECT doc_id, line_no, list_extract([{", ".join(map(S.lit, _MARKS))}], ((doc_id + line_no) % {len(_MARKS)} + 1)::INTEGER) || line AS t FROM ({_LINES}))
""")
def bullet_strip(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.get(F.array(*map(F.lit, _MARKS)), ((F.col("doc_id") + F.col("line_no")) % len(_MARKS)).cast("int")), "line")
    return L.lines(table(spark, d, "documents")).select("doc_id", "line_no", T.is_bullet(t).alias("is_bullet"), F.sha2(T.without_bullet(t), 256).alias("body"))


@query(f"""
SELECT doc_id, line_no, sha256(array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || CASE WHEN i <= len(m) THEN 'ZXQNT' || (i - 1) || 'QXZ' ELSE '' END), '')) AS masked, len(m)::BIGINT AS n_masks
FROM (SELECT doc_id, line_no, string_split_regex(line, {S.lit(masking.EMAIL)}) AS b, regexp_extract_all(line, {S.lit(masking.EMAIL)}) AS m FROM ({_LINES}))
""")
def mask_email(spark: SparkSession, d: str) -> DataFrame:
    """Addresses alone masked in all lines; mask_roundtrip covers links and handles, which need lookarounds."""
    m = L.lines(table(spark, d, "documents")).withColumn("m", masking.mask(F.col("line"), masking.EMAIL))
    return m.select("doc_id", "line_no", F.sha2("m.masked", 256).alias("masked"), F.size("m.replacements").cast("long").alias("n_masks"))


@query("""
WITH p AS (SELECT page_id, html || ' (' || url || '). Contact @user' || page_id || ' or a.b' || page_id || '@example.org, please.' AS text FROM pages)
SELECT page_id, sha256(text) AS restored, sha256(text) AS from_spaced FROM p
""")
def mask_restored(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages with an address, a link and a handle masked and put back, also from spaced tokens."""
    p = _marked_pages(spark, d)
    spaced = F.regexp_replace("masked", "ZXQNT", "zxqnt ")
    return p.select("page_id", F.sha2(masking.unmask(F.col("masked"), F.col("replacements")), 256).alias("restored"), F.sha2(masking.unmask(spaced, F.col("replacements")), 256).alias("from_spaced"))


def _marked_pages(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("html", F.lit(" ("), F.col("url"), F.lit("). Contact @user"), F.col("page_id").cast("string"), F.lit(" or a.b"), F.col("page_id").cast("string"), F.lit("@example.org, please."))
    m = table(spark, d, "pages").select("page_id", text.alias("text")).withColumn("m", masking.mask(F.col("text")))
    return m.select("page_id", "text", "m.masked", "m.replacements")


# RE2 looks neither back nor ahead, so handles are put between two control characters first, and these are taken out again.
_HANDLES = r"(^|[^\p{L}\p{N}_.@!#$%&'*+/=?^`{|}~\x{1}-])(@[A-Za-z0-9_]{2,30})($|[^\p{L}\p{N}_])"
_MASKABLE = rf"{masking.EMAIL}|{masking.URL}|\x{{1}}@[A-Za-z0-9_]+\x{{2}}"
_OWN_MASK = r"(?:^|[^\p{L}\p{N}_])ZXQNT\p{Nd}+QXZ"


def _masked_sql(rows: str) -> str:
    """The columns of rows, which have a text, and masked, replacements, unmasked (the words besides the masks)."""
    marked = lambda c: f"regexp_replace({c}, {S.lit(_HANDLES)}, '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
    link = f"NOT regexp_matches(v, {S.lit(f'^(?:{masking.EMAIL})$')}) AND regexp_matches(v, '^(?:https?://|www[.])')"
    return f"""
SELECT * EXCLUDE (marked, b, v, k), {S.sub("masked", _OWN_MASK, " ")} AS unmasked FROM (
  SELECT *, k AS replacements, translate(array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || CASE WHEN i <= len(v) THEN 'ZXQNT' || (i - 1) || 'QXZ' || substr(v[i], length(k[i]) + 1) ELSE '' END), ''), chr(1) || chr(2), '') AS masked FROM (
  SELECT *, list_transform(v, lambda v: CASE WHEN {link} THEN regexp_replace(v, {S.lit(r"""[.,;:!?)\]}"']+$""")}, '') ELSE v END) AS k FROM (
  SELECT *, string_split_regex(marked, {S.lit(_MASKABLE)}) AS b, list_transform(regexp_extract_all(marked, {S.lit(_MASKABLE)}), lambda v: translate(v, chr(1) || chr(2), '')) AS v
  FROM (SELECT *, {marked(marked("text"))} AS marked FROM ({rows})))))"""


_TWO_LETTERS = f"{S.letters('unmasked')} >= 2"
_NAME = r"\p{L}+(?:[-']\p{L}+)?"
_NAMED = f"len(replacements) > 0 AND len(f) BETWEEN 2 AND 8 AND len(list_filter(f, lambda w: NOT ({S.among('lower(w)', fixed.CONTACT_WORDS)} OR regexp_matches(w, '^\\p{{Lu}}')))) = 0"


def _identity_sql(rows: str) -> str:
    """_masked_sql of rows, and translatable and identity."""
    return f"SELECT *, {_TWO_LETTERS} AS translatable, {_NAMED} AS identity FROM (SELECT *, regexp_extract_all(unmasked, {S.lit(_NAME)}) AS f FROM ({_masked_sql(rows)}))"


_PAGE_TEXTS = "SELECT page_id, html || ' (' || url || '). Contact @user' || page_id || ' or a.b' || page_id || '@example.org, please.' AS text FROM pages"


@query(f"SELECT page_id, sha256(masked) AS masked, replacements, translatable, identity FROM ({_identity_sql(_PAGE_TEXTS)})")
def mask_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, links and handles of whole pages masked."""
    return _marked_pages(spark, d).select("page_id", F.sha2("masked", 256).alias("masked"), "replacements", P.unmasked_text(F.col("masked")).alias("translatable"), P.contact_identity(F.col("masked")).alias("identity"))


_HEADED = ["", "Contact: Ann Lee, ", "@editor_1 ", "Web page (www.example.org/a_b), "]
_HEADED_SQL = f"SELECT doc_id, line_no, list_extract([{', '.join(map(S.lit, _HEADED))}], ((doc_id + line_no) % {len(_HEADED)} + 1)::INTEGER) || CASE WHEN length(line) < 40 OR line_no % 3 = 0 THEN line ELSE 'Oslo' END AS text FROM ({_LINES})"


@query(f"SELECT doc_id, line_no, sha256(masked) AS masked, len(replacements)::BIGINT AS n_masks, len(replacements) > 0 AS has_mask, translatable, identity FROM ({_identity_sql(_HEADED_SQL)})")
def contact_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines under labels and names: what is masked, whether words are left to translate, whether they only say whom to ask."""
    head = F.get(F.array(*map(F.lit, _HEADED)), ((F.col("doc_id") + F.col("line_no")) % len(_HEADED)).cast("int"))
    body = F.when((F.length("line") < 40) | (F.col("line_no") % 3 == 0), F.col("line")).otherwise("Oslo")
    m = L.lines(table(spark, d, "documents")).select("doc_id", "line_no", masking.mask(F.concat(head, body)).alias("m"))
    masked = F.col("m.masked")
    return m.select(
        "doc_id", "line_no", F.sha2(masked, 256).alias("masked"), F.size("m.replacements").cast("long").alias("n_masks"), P.has_mask(masked).alias("has_mask"), P.unmasked_text(masked).alias("translatable"),
        P.contact_identity(masked).alias("identity"),
    )


_STARTS = ["", "[12] ", "3. Xy ", "References ", "Figure 2 ", "page 3", "12345", "doi:10.1/x ", "http://a.b ", "2.1 Methods ", "Smith (2019) doi: ", "fig.a ", "Keywords: ", "Bibliography:"]
_STARTED = f"SELECT doc_id, line_no, list_extract([{', '.join(map(S.lit, _STARTS))}], ((doc_id + line_no) % {len(_STARTS)} + 1)::INTEGER) || line AS t FROM ({_LINES})"


@query(f"SELECT doc_id, line_no, {S.reference_line('t')} AS reference_line, {S.reference_heading('t')} AS reference_heading, {S.starts_structure('t')} AS starts_structure, {S.header_or_footer('t')} AS header_or_footer FROM ({_STARTED})")
def line_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules on whole lines, which begin with one of some marks."""
    mark = F.get(F.array(*map(F.lit, _STARTS)), ((F.col("doc_id") + F.col("line_no")) % len(_STARTS)).cast("int"))
    t = F.col("t")
    started = L.lines(table(spark, d, "documents")).select("doc_id", "line_no", F.concat(mark, "line").alias("t"))
    return started.select("doc_id", "line_no", P.reference_line(t).alias("reference_line"), P.reference_heading(t).alias("reference_heading"), P.starts_structure(t).alias("starts_structure"), P.header_or_footer(t).alias("header_or_footer"))


@query(f"SELECT doc_id, line_no, {S.reference_line('t')} AS reference_line, {S.reference_heading('t')} AS reference_heading, {S.header_or_footer('t')} AS header_or_footer FROM (SELECT doc_id, line_no, left(t, (8 + line_no % 11)::INTEGER) AS t FROM ({_STARTED}))")
def bare_line_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules on short lines: what all lines begin with, marks that stand nearly alone among them."""
    mark = F.get(F.array(*map(F.lit, _STARTS)), ((F.col("doc_id") + F.col("line_no")) % len(_STARTS)).cast("int"))
    short = F.left(F.concat(mark, "line"), (8 + F.col("line_no") % 11).cast("int"))
    t = F.col("t")
    each = L.lines(table(spark, d, "documents")).select("doc_id", "line_no", short.alias("t"))
    return each.select("doc_id", "line_no", P.reference_line(t).alias("reference_line"), P.reference_heading(t).alias("reference_heading"), P.header_or_footer(t).alias("header_or_footer"))


@query(f"SELECT doc_id, line_no, {S.sentence_boundary('line', 'nxt')} AS boundary FROM (SELECT doc_id, line_no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM ({_LINES})) WHERE nxt IS NOT NULL")
def sentence_boundaries(spark: SparkSession, d: str) -> DataFrame:
    p = L.lines(table(spark, d, "documents")).withColumn("nxt", F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))).where("nxt is not null")
    return p.select("doc_id", "line_no", P.sentence_boundary(F.col("line"), F.col("nxt")).alias("boundary"))


_UNITS = ["mg", "kg", " mL", "m2", "m²", "%", "%a", " km", ""]


@query(f"""
SELECT l_orderkey, l_linenumber, {S.table_row("t")} AS is_table FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '• ' ELSE 'x' || chr(9) END || 'dose ' || l_quantity::INTEGER || list_extract([{", ".join(map(S.lit, _UNITS))}], (l_orderkey % {len(_UNITS)} + 1)::INTEGER) AS t FROM lineitem WHERE l_linenumber <> 3
  UNION ALL SELECT l_orderkey, l_linenumber, l_shipmode AS t FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode FROM lineitem WHERE l_linenumber = 3))
""")
def table_row_rule(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber")
    unit = F.get(F.array(*map(F.lit, _UNITS)), (F.col("l_orderkey") % len(_UNITS)).cast("int"))
    t = F.when(k == 3, F.col("l_returnflag")).otherwise(F.concat(F.when(k % 2 == 0, "• ").otherwise("x\t"), F.lit("dose "), F.col("l_quantity").cast("int").cast("string"), unit))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.table_row(t).alias("is_table"))


_BLOCKS = f"SELECT doc_id, line_no, {S.collapse('line')} AS text, CASE WHEN (doc_id + line_no) % 7 = 0 THEN 'caption' WHEN (doc_id + line_no) % 11 = 0 THEN 'label' ELSE 'paragraph' END AS kind FROM ({_LINES})"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") + F.col("line_no")
    return L.lines(table(spark, d, "documents")).select("doc_id", "line_no", T.collapse(F.col("line")).alias("text"), F.when(k % 7 == 0, "caption").when(k % 11 == 0, "label").otherwise("paragraph").alias("kind"))


@query(f"""
SELECT doc_id, rank::INTEGER AS rank, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rank FROM ({_BLOCKS}) WHERE length(text) >= 24 AND NOT {S.not_sampled("text", "kind")}) WHERE rank <= 36
""")
def detection_sample_filter(spark: SparkSession, d: str) -> DataFrame:
    return L.detection_candidates(_blocks(spark, d), "line_no")


@query(f"""
WITH RECURSIVE b AS (SELECT doc_id, line_no, text, kind FROM ({_BLOCKS})),
c AS (SELECT doc_id, rank, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rank FROM b WHERE length(text) >= 24 AND NOT {S.not_sampled("text", "kind")}) WHERE rank <= 36),
f(doc_id, rank, chunk_no, held, chars) AS (
  SELECT doc_id, rank, 0, text, length(text) FROM c WHERE rank = 1
  UNION ALL SELECT c.doc_id, c.rank, CASE WHEN f.chars >= 320 THEN f.chunk_no + 1 ELSE f.chunk_no END, CASE WHEN f.chars >= 320 THEN c.text ELSE f.held || ' ' || c.text END, CASE WHEN f.chars >= 320 THEN length(c.text) ELSE f.chars + length(c.text) END
  FROM f JOIN c ON c.doc_id = f.doc_id AND c.rank = f.rank + 1),
s AS (SELECT doc_id, chunk_no, max(length(held)) AS chunk_len FROM f WHERE chunk_no < 18 GROUP BY doc_id, chunk_no),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS chunk_no, length(text) AS chunk_len FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos FROM b) WHERE pos <= 18 AND text <> '' AND doc_id NOT IN (SELECT doc_id FROM c))
SELECT doc_id, chunk_no::INTEGER AS chunk_no, chunk_len::BIGINT AS chunk_len FROM s UNION ALL SELECT doc_id, chunk_no::INTEGER, chunk_len::BIGINT FROM p
""")
def detection_sample_chunks(spark: SparkSession, d: str) -> DataFrame:
    return L.detection_samples(_blocks(spark, d), "line_no").select("doc_id", "chunk_no", F.length("chunk").cast("long").alias("chunk_len"))


@query(f"""
SELECT doc_id, line_no, NOT (length(t) < 24 OR {S.like("lower(t)", r"(?:^|[^\p{L}\p{N}_])(?:https?://|www\.)|@")} OR {S.letters("t")} < 12 OR {S.digits("t")} >= greatest(4, floor({S.letters("t")} * 0.35))) AS kept
FROM (SELECT doc_id, line_no, {S.collapse("line")} AS t FROM ({_NUMBERED}))
""")
def sample_noise_filter(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("doc_id", "line_no", (~P.noisy_sample(T.collapse(F.col("line")))).alias("kept"))


# A blank line after some sentences.
_SPARSE = "replace(text, 'n. ', 'n.' || chr(10) || chr(10))"


@query(rf"""
WITH t AS (SELECT doc_id, {_SPARSE} AS text FROM documents),
l AS (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS p FROM t)),
b AS (SELECT *, trim(line, ' ' || chr(10)) = '' AS blank FROM l),
s AS (SELECT *, CASE WHEN blank OR coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), true) THEN 1 ELSE 0 END AS starts FROM b),
n AS (SELECT *, (sum(starts) OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INTEGER AS seg_no FROM s)
SELECT doc_id, seg_no, sum(length(line))::BIGINT AS seg_len, bool_or(blank) AS is_blank FROM n GROUP BY doc_id, seg_no
""")
def segment_islands(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("n. "), F.lit("n.\n\n")).alias("text"))
    return L.segments(docs).select("doc_id", "seg_no", F.length("segment").cast("long").alias("seg_len"), "is_blank")


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def segment_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to segments and joined again."""
    return L.join_segments(L.segments(table(spark, d, "documents"))).select("doc_id", F.sha2("text", 256).alias("sha"))


@query(f"""
SELECT conv_id, turn, ((row_number() OVER w - 1) // 3)::INTEGER AS batch_no, ((row_number() OVER w - 1) % 3)::INTEGER AS "offset" FROM conversations WHERE {S.strip("text")} <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def segment_batches(spark: SparkSession, d: str) -> DataFrame:
    return L.batches(table(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "batch_no", "offset")


@query(f"SELECT doc_id, {S.times('text', r'[\x{e0}-\x{ff}]')} AS script_chars, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_](?:[\\p{{L}}\\p{{N}}_-]*[\\p{{L}}\\p{{N}}_])?'), lambda t: {S.among('t', fixed.STOPWORDS)}))::BIGINT AS hits FROM documents")
def script_and_token_measures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", qa.script_chars(F.col("text"), 0xE0, 0xFF).cast("long").alias("script_chars"), qa.token_hits(F.col("text"), fixed.STOPWORDS).cast("long").alias("hits"))


@query(f"""
SELECT doc_id, len(t)::BIGINT AS tokens, len(h)::BIGINT AS hits, len(t) >= 10 AND len(h) >= 6 AND len(h) / len(t) >= 0.22 AS flagged
FROM (SELECT doc_id, t, list_filter(t, lambda x: {S.among("x", fixed.STOPWORDS)}) AS h FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z'']+') AS t FROM documents))
""")
def stopword_leak(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    found = F.regexp_extract_all(t, F.lit("[a-zA-Z']+"), F.lit(0))
    hits = F.size(F.filter(found, lambda x: x.isin(*fixed.STOPWORDS)))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("tokens"), hits.cast("long").alias("hits"), P.english_left(t).alias("flagged"))


_CODES = [" EN-us", "el_GR", "xx", "e", "deu", "PT", "ga", "mt ", "12", "fr"]
_CODE = f"list_extract([{', '.join(map(S.lit, _CODES))}], (doc_id % {len(_CODES)} + 1)::INTEGER)"


@query(f"""
SELECT doc_id, {S.language_code("c")} AS code, {S.language_error("c")} AS error, {S.service_supports("c")} AS supported,
  CASE WHEN NOT {S.service_supports("c")} THEN NULL WHEN {S.language_code("c")} = 'en' THEN 'EN-GB' WHEN {S.language_code("c")} = 'pt' THEN 'PT-PT' ELSE upper({S.language_code("c")}) END AS service_code,
  CASE {" ".join(f"WHEN {S.language_code('c')} = '{k}' THEN {v}" for k, v in fixed.EXPANSION.items())} ELSE {fixed.DEFAULT_EXPANSION} END::DOUBLE AS ratio
FROM (SELECT doc_id, {_CODE} AS c FROM documents)
""")
def language_rules(spark: SparkSession, d: str) -> DataFrame:
    c = F.get(F.array(*map(F.lit, _CODES)), (F.col("doc_id") % len(_CODES)).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.language_code(c).alias("code"), T.language_error(c).alias("error"), T.service_supports(c).alias("supported"), T.service_target(c).alias("service_code"), T.expansion_ratio(c).alias("ratio"))


@query(f"""
SELECT doc_id, ratio, round(least(1.0, 1 / sqrt(ratio)), 6)::DOUBLE AS scale
FROM (SELECT doc_id, CASE {" ".join(f"WHEN lang = '{k}' THEN {v}" for k, v in fixed.EXPANSION.items())} ELSE {fixed.DEFAULT_EXPANSION} END::DOUBLE AS ratio FROM documents)
""")
def expansion_scale(spark: SparkSession, d: str) -> DataFrame:
    """How much longer a document gets in its language, and how much smaller its letters for that."""
    return table(spark, d, "documents").select("doc_id", T.expansion_ratio(F.col("lang")).alias("ratio"), F.round(T.area_scale(F.col("lang")), 6).alias("scale"))


@query(f"""
SELECT doc_id, sha256({S.sub("text", r"[^\p{L}\p{N}_-]", "_")}) AS safe, {S.like("text", r"[^\x{0}-\x{ff}]|•")} AS unicode_font,
  translate(text, '“’✓', '"''✔') = text AS plain, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped,
  lower(substr(text, 1, 3)) LIKE '%bd' OR lower(text) LIKE '%bold%' AS bold
FROM documents
""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(F.regexp_replace(t, r"[^\p{L}\p{N}_-]", "_"), 256).alias("safe"), T.needs_unicode_font(t).alias("unicode_font"), (T.sanitized(t) == t).alias("plain"), F.sha2(T.html_escape(t), 256).alias("escaped"),
        (F.endswith(F.lower(F.substring(t, 1, 3)), F.lit("bd")) | F.contains(F.lower(t), F.lit("bold"))).alias("bold"),
    )


# Replies of a model about one turn: fenced JSON, bare JSON, JSON that breaks off after its first pair, no JSON.
@query(f"""
SELECT conv_id, turn, turn::VARCHAR AS key, sha256(replace(text, chr(92), '')) AS value FROM conversations WHERE (conv_id + turn) % 4 <> 3
""")
def reply_parse(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 4
    text = F.replace("text", F.lit("\\"), F.lit(""))
    whole = F.to_json(F.create_map(F.col("turn").cast("string"), text))
    broken = F.concat(F.lit('Sure: {"'), F.col("turn").cast("string"), F.lit('": "'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('", "999": "tail'))
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k == 1, whole).when(k == 2, broken).otherwise(F.concat(F.lit("no json: "), F.regexp_replace(text, '"', "'")))
    c = table(spark, d, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return c.select("conv_id", "turn", F.explode(T.reply_map(F.col("reply"))).alias("key", "value")).select("conv_id", "turn", "key", F.sha2("value", 256).alias("value"))


@query("""
SELECT event_id, CASE WHEN s < 60 THEN format('{:.1f}s', s) WHEN s < 3600 THEN floor(s / 60)::INTEGER || 'm ' || format('{:.1f}s', s % 60) ELSE floor(s / 3600)::INTEGER || 'h ' || (floor(s / 60) % 60)::INTEGER || 'm ' || format('{:.1f}s', s % 60) END AS took
FROM (SELECT event_id, (event_id * 37 % 90000) / 8 AS s FROM events)
""")
def durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.duration((F.col("event_id") * 37 % 90000) / 8).alias("took"))


# The tables' pages have no more than these references, and no element without its end but void ones.
_BARE = "regexp_replace(regexp_replace(html, '(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g')"
DECODED = "t"
for _name, _code in (("lt", 60), ("gt", 62), ("quot", 34), ("nbsp", 160), ("copy", 169), ("middot", 183), ("amp", 38)):
    DECODED = f"regexp_replace({DECODED}, '&{_name};?', chr({_code}), 'g')"


# A text is under the last tag that opened at its depth, where each element ends as it should.
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "x")
_OPENED = r"lower(regexp_extract(t, '^<([a-zA-Z][a-zA-Z0-9]*)', 1))"


def html_text_sql(c: str) -> str:
    number = f"regexp_replace({c}, '[.,-]', '', 'g')"
    return f"(length({c}) >= 3 AND {S.letters(c)} >= 2 AND NOT {S.like(c, r'^&(?:[\p{L}\p{N}_]+|#\p{Nd}+);$')} AND NOT {S.like(number, r'^\p{Nd}+$')})"


@query(f"""
WITH p AS (SELECT page_id, unnest(range(len(p))) AS k, unnest(p) AS t FROM (SELECT page_id, regexp_extract_all({_BARE}, '<[^>]*>|[^<]+') AS p FROM pages)),
o AS (SELECT *, CASE WHEN {_OPENED} <> '' AND NOT {S.among(_OPENED, _VOID)} AND t NOT LIKE '%/>' THEN {_OPENED} END AS opened FROM p),
e AS (SELECT *, sum(CASE WHEN opened IS NOT NULL THEN 1 WHEN t LIKE '</%' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k) AS depth FROM o),
n AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY page_id, depth ORDER BY k) AS tag FROM e),
c AS (SELECT page_id, k, tag, {S.strip(DECODED)} AS core FROM n WHERE t NOT LIKE '<%')
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INTEGER AS node_id, tag, core,
  {html_text_sql("core")} AS ok FROM c
""")
def html_nodes(spark: SparkSession, d: str) -> DataFrame:
    return html.text_nodes(table(spark, d, "pages")).select("page_id", "node_id", "tag", "core", F.col("translatable").alias("ok"))


@query(f"""
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INTEGER AS node_id, {S.strip(DECODED)} AS core
FROM (SELECT page_id, unnest(range(len(p))) AS k, unnest(p) AS t FROM (SELECT page_id, string_split_regex({_BARE}, '<[^>]*>') AS p FROM pages)) WHERE t <> ''
""")
def html_node_texts(spark: SparkSession, d: str) -> DataFrame:
    return html.text_nodes(table(spark, d, "pages")).select("page_id", "node_id", "core")


_MAPPING = "SELECT DISTINCT ON (text) text AS key, upper(text) AS value FROM conversations WHERE conv_id % 3 = 0 AND turn % 2 = 0"


@query(f"""
WITH m AS (SELECT DISTINCT {S.strip("text")} AS key FROM conversations WHERE conv_id % 3 = 0 AND {S.strip("text")} <> ''),
c AS (SELECT conv_id, turn, '  ' || text || chr(10) AS text FROM conversations)
SELECT conv_id, turn, sha256(CASE WHEN key IS NULL THEN c.text ELSE replace(c.text, key, '<' || key || '>') END) AS new_text, key IS NOT NULL AS replaced
FROM c LEFT JOIN m ON {S.strip("c.text")} = m.key
""")
def mapping_replace(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.translate import replace_mapped

    c = table(spark, d, "conversations")
    key = T.strip(F.col("text"))
    m = c.where(F.col("conv_id") % 3 == 0).select(key.alias("key")).where("key <> ''").distinct().withColumn("value", F.concat(F.lit("<"), "key", F.lit(">")))
    out = replace_mapped(c.select("conv_id", "turn", F.concat(F.lit("  "), "text", F.lit("\n")).alias("text")), m)
    return out.select("conv_id", "turn", F.sha2("new_text", 256).alias("new_text"), "replaced")


@query("SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events)")
def mapping_scan(spark: SparkSession, d: str) -> DataFrame:
    return files.mapping(table(spark, d, "events"), "props", ["event_id"])


@query(f"""
WITH r AS (SELECT conv_id, turn // 2 AS para, turn % 2 AS run, text FROM conversations WHERE {S.strip("text")} <> '')
SELECT conv_id, para::BIGINT AS para, sha256(string_agg(text, '' ORDER BY run)) AS text, min(run)::BIGINT AS first_run FROM r GROUP BY conv_id, para
""")
def paragraph_grouping(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("para"), (F.col("turn") % 2).alias("run"), "text")
    return files.paragraphs(r, ("conv_id", "para")).select("conv_id", "para", F.sha2("text", 256).alias("text"), "first_run")


@query(f"""
WITH r AS (SELECT conv_id, turn // 2 AS para, turn % 2 AS run, text FROM conversations),
f AS (SELECT *, min(run) FILTER ({S.strip("text")} <> '') OVER (PARTITION BY conv_id, para) AS first_run, string_agg(upper(text), '' ORDER BY run) FILTER ({S.strip("text")} <> '') OVER (PARTITION BY conv_id, para) AS t FROM r)
SELECT conv_id, para::BIGINT AS para, run::BIGINT AS run, sha256(CASE WHEN {S.strip("text")} = '' OR para % 3 = 0 THEN text WHEN run = first_run THEN 'T' || conv_id ELSE '' END) AS new_text FROM f
""")
def first_run_projection(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("para"), (F.col("turn") % 2).alias("run"), "text")
    t = files.paragraphs(r, ("conv_id", "para")).where("para % 3 <> 0").select("conv_id", "para", F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("translation"))
    return files.written_runs(r, t, ("conv_id", "para")).select("conv_id", "para", "run", F.sha2("new_text", 256).alias("new_text"))


@query("SELECT doc_id, sha256(CASE doc_id % 3 WHEN 2 THEN 'é“ ' || text WHEN 1 THEN chr(65279) || text ELSE text END) AS sha FROM documents")
def charset_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Texts written in several charsets and read back."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 3
    data = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8"))).otherwise(F.concat(F.lit(b"\xe9\x93 "), F.encode("text", "ISO-8859-1")))
    return docs.select("doc_id", F.sha2(files.decoded(data), 256).alias("sha"))


@query(f"""
WITH s AS (SELECT doc_id, list(line ORDER BY line_no) AS s FROM ({_LINES}) GROUP BY doc_id)
SELECT doc_id, sha256(array_to_string(list_transform(s[1:10], lambda x: '- ' || left(x, 280)), chr(10))) AS listed, left({S.strip("s[1]")}, 200) AS first_sample,
  left({S.strip("s[-1]")}, 60) || CASE WHEN length({S.strip("s[-1]")}) > 60 THEN '…' ELSE '' END AS snippet FROM s
""")
def sample_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """What is asked about a document's language, and how a text is named in a report."""
    s = L.lines(table(spark, d, "documents")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("s"))
    return s.select("doc_id", F.sha2(T.listed_samples(F.col("s")), 256).alias("listed"), T.first_sample(F.col("s")).alias("first_sample"), T.excerpt(T.strip(F.element_at("s", -1)), 60).alias("snippet"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n <= 20")
def first_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of an image that are used: the first twenty."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("no"))
    return L.first_rows(rows, "l_suppkey", "no", 20).select("l_orderkey", "l_linenumber")


@query("SELECT page_id, 'data:' || CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'image/svg+xml' END || ';base64,' || base64(encode(html)) AS url FROM pages")
def data_urls(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, ("no suffix", "a.JPG", "b.c.svg"))), (F.col("page_id") % 3).cast("int"))
    return table(spark, d, "pages").select("page_id", T.data_url(F.encode("html", "UTF-8"), name).alias("url"))
