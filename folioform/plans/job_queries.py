"""Queries over translation, requests and jobs."""

from __future__ import annotations

import codecs
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import predicates as P
from ..functions import text as T
from ..operators import jobs as J
from ..operators import qa
from ..operators import translate as R
from . import sql as S
from .registry import query, table
from .text_queries import DECODED, html_text_sql

_PAIRS = "SELECT conv_id, turn, text AS src, CASE WHEN turn % 5 = 0 THEN repeat(left(text, 20) || ' ', 12) WHEN turn % 7 = 1 THEN text ELSE lead(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS dst FROM conversations"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turn = F.col("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("src"), F.when(turn % 5 == 0, F.repeat(F.concat(F.left("text", F.lit(20)), F.lit(" ")), F.lit(12))).when(turn % 7 == 1, F.col("text")).otherwise(nxt).alias("dst"))


@query(f"""
WITH p AS (SELECT conv_id, turn, {S.collapse("src")} AS src, {S.collapse("coalesce(dst, '')")} AS dst FROM ({_PAIRS})),
w AS (SELECT *, {S.words("dst")} AS w FROM p),
g AS (SELECT conv_id, turn, max(n) AS most FROM (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w) GROUP BY ALL) GROUP BY ALL)
SELECT w.conv_id, w.turn, dst = '' AS empty, length(dst) > greatest(length(src) * 2.4, length(src) + 120.0) OR (len(w) >= 16 AND (len(list_distinct(w)) / len(w) < 0.4 OR coalesce(most, 0) >= 3)) AS degenerate
FROM w LEFT JOIN g ON w.conv_id = g.conv_id AND w.turn = g.turn
""")
def degenerate_translation(spark: SparkSession, d: str) -> DataFrame:
    src, dst = T.collapse(F.col("src")), T.collapse(F.coalesce("dst", F.lit("")))
    return _pairs(spark, d).select("conv_id", "turn", (dst == "").alias("empty"), P.degenerate(src, dst).alias("degenerate"))


@query()
def leak_check(spark: SparkSession, d: str) -> DataFrame:
    """Translations that must be tried again: empty, unchanged, degenerate, leaking their source."""
    p = _pairs(spark, d).withColumn("source_lang", F.lit("en")).withColumn("target_lang", F.when(F.col("conv_id") % 11 == 0, "en").otherwise("fr"))
    return R.suspicious(p).select("conv_id", "turn", "suspicious")


@query("SELECT c.conv_id, c.turn, CASE WHEN (c.conv_id + c.turn) % 3 = 0 OR (c.conv_id + c.turn) % 4 = 1 THEN c.text ELSE 'reply ' || c.turn END AS final_text FROM conversations c")
def translation_apply(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    k = F.col("conv_id") + F.col("turn")
    replies = c.where(k % 3 != 0).select("conv_id", "turn", F.when(k % 4 == 1, "").otherwise(F.concat(F.lit("reply "), F.col("turn").cast("string"))).alias("reply"))
    return R.apply_replies(c, replies, ["conv_id", "turn"]).select("conv_id", "turn", "final_text")


_PLAIN = string.ascii_lowercase + string.ascii_uppercase
_TURNED = codecs.encode(_PLAIN, "rot13")
# Replies, the rules on them, and calls of three rows. The SQL lacks the rule on common stretches: letters go 13 places on, so nothing
# of 28 characters stays, nor is a reply much like its source. The second reply is the first one, so what is doubtful is refused.
def judged(rows: str, key: str, order: str, size: int) -> str:
    """SQL: tables up to done (key, order, text, final_text, state, calls, retried), of rows (key, order, text) in calls of `size`."""
    return f"""
r AS (SELECT {key}, {order}, text, {S.collapse("lower(text)")} AS src, translate(text, '{_PLAIN}', '{_TURNED}') AS reply, {S.strip("text")} <> '' AS asked,
  count(*) FILTER ({S.strip("text")} <> '') OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS nth FROM {rows}),
s AS (SELECT *, {S.collapse("lower(reply)")} AS dst FROM r),
w AS (SELECT *, {S.words("dst")} AS w, regexp_extract_all(dst, '[a-zA-Z'']+') AS t FROM s),
g AS (SELECT {key}, {order}, max(n) AS most FROM (SELECT {key}, {order}, g, count(*) AS n FROM (SELECT {key}, {order}, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w) GROUP BY ALL) GROUP BY ALL),
h AS (SELECT w.*, most, len(list_filter(t, lambda x: {S.among("x", fixed.STOPWORDS)})) AS hits FROM w LEFT JOIN g USING ({key}, {order})),
j AS (SELECT *, dst = '' OR src = dst OR length(dst) > greatest(length(src) * 2.4, length(src) + 120.0) OR (len(w) >= 16 AND (len(list_distinct(w)) / len(w) < 0.4 OR coalesce(most, 0) >= 3))
  OR (len(t) >= 10 AND hits >= 6 AND hits / len(t) >= 0.22) AS doubtful FROM h),
done AS (SELECT {key}, {order}, text, CASE WHEN asked AND NOT doubtful THEN reply ELSE text END AS final_text, CASE WHEN asked AND doubtful THEN 'rejected' WHEN asked THEN 'translated' ELSE 'blank' END AS state,
  CASE WHEN asked THEN (nth % {size} = 0)::INTEGER + (doubtful AND reply <> '')::INTEGER ELSE 0 END AS calls, asked AND doubtful AND reply <> '' AS retried FROM j)"""


# Some turns say the same again and again, or hold no letter that changes: these are asked for twice and stay.
_SPOKEN = "SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN repeat(left(text, 20) || ' ', 12) WHEN turn % 7 = 3 THEN length(text) || ' %' ELSE text END AS text FROM conversations"
_JUDGED = f"WITH {judged(f'({_SPOKEN})', 'conv_id', 'turn', 3)}"


def _translated(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    spoken = F.when(turn % 5 == 4, F.repeat(F.concat(F.left("text", F.lit(20)), F.lit(" ")), F.lit(12))).when(turn % 7 == 3, F.concat(F.length("text").cast("string"), F.lit(" %"))).otherwise(F.col("text"))
    return R.translate_batches(table(spark, d, "conversations").select("conv_id", "turn", spoken.alias("text")), "conv_id", "turn", "cipher", "en", "fr", 3)


@query(f"{_JUDGED} SELECT conv_id, turn, final_text, state, calls FROM done")
def batch_translation(spark: SparkSession, d: str) -> DataFrame:
    """Turns translated in batches by a stand-in provider, with retry and what stays."""
    return _translated(spark, d).select("conv_id", "turn", "final_text", "state", "calls")


@query(f"{_JUDGED} SELECT conv_id, count(*) AS total, count(*) FILTER (state = 'translated') AS translated, count(*) FILTER (state = 'rejected') AS rejected, sum(calls)::BIGINT AS calls FROM done GROUP BY conv_id")
def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    return qa.segment_stats(_translated(spark, d), "conv_id")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'view') AS translated, count(*) FILTER (event_type = 'error') AS rejected, sum(event_id % 3)::BIGINT AS calls FROM events GROUP BY user_id")
def segment_counters(spark: SparkSession, d: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    state = F.when(kind == "view", "translated").when(kind == "error", "rejected").otherwise("blank")
    return qa.segment_stats(table(spark, d, "events").select("user_id", state.alias("state"), (k % 3).cast("int").alias("calls")), "user_id")


_NODES = "SELECT user_id, event_type = 'purchase' OR event_id % 3 = 0 AS applied, event_id % 7 = 0 AS retried, event_type = 'error' AS rejected, (event_id % 3)::INTEGER AS calls FROM events"


@query(f"SELECT user_id, count(*) FILTER (applied) AS nodes_translated, count(*) FILTER (NOT applied) AS nodes_skipped, count(*) FILTER (retried) AS nodes_retried, count(*) FILTER (rejected) AS nodes_rejected, sum(calls)::BIGINT AS api_calls FROM ({_NODES}) GROUP BY user_id")
def html_counters(spark: SparkSession, d: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    nodes = table(spark, d, "events").select("user_id", ((kind == "purchase") | (k % 3 == 0)).alias("applied"), (k % 7 == 0).alias("retried"), (kind == "error").alias("rejected"), (k % 3).cast("int").alias("calls"))
    return qa.html_stats(nodes, "user_id")


_PARTS = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<!--.*?-->|<[^>]*>|[^<]+"
_EDGE = T.SPACE + "*"


@query(f"""
WITH p AS (SELECT page_id, unnest(range(len(p))) AS k, unnest(p) AS t FROM (SELECT page_id, regexp_extract_all(html, {S.lit(_PARTS)}) AS p FROM pages)),
c AS (SELECT *, {S.strip("body")} AS core FROM (SELECT *, {DECODED} AS body FROM p WHERE t NOT LIKE '<%')),
q AS (SELECT page_id, k, core AS text FROM c WHERE {html_text_sql("core")}),
{judged("q", "page_id", "k", R.MOST_ROWS)},
f AS (SELECT c.page_id, c.k, c.body, d.state, d.calls, d.retried, {S.strip(S.sub("d.final_text", f"{T.SPACE}*\n+{T.SPACE}*", " "))} AS line FROM c LEFT JOIN done d ON c.page_id = d.page_id AND c.k = d.k),
n AS (SELECT page_id, k, state, calls, retried, CASE WHEN state = 'translated' AND line <> '' THEN
  replace(replace(replace(regexp_extract(body, {S.lit("^" + _EDGE)}) || line || regexp_extract(body, {S.lit(_EDGE + "$")}), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END AS new_text FROM f)
SELECT page_id, sha256(string_agg(coalesce(new_text, t), '' ORDER BY k)) AS html_sha256, count(new_text) AS nodes_translated, count(*) FILTER (t NOT LIKE '<%') - count(new_text) AS nodes_skipped,
  count(*) FILTER (retried) AS nodes_retried, count(*) FILTER (state = 'rejected') AS nodes_rejected, coalesce(sum(calls), 0)::BIGINT AS api_calls FROM p LEFT JOIN n USING (page_id, k) GROUP BY page_id
""")
def html_applied(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their text nodes translated by a stand-in and put back, and the counters."""
    from ..api import Pages

    done = Pages(table(spark, d, "pages").select("page_id", "html")).translate("cipher", "en", "fr")
    return done.pages.select("page_id", F.sha2("html", 256).alias("html_sha256")).join(done.stats(), "page_id", "left")


_TRIED = "SELECT event_id, user_id, CASE WHEN value > 0 AND event_id % 5 < 3 THEN 'fit' WHEN event_id % 5 = 3 THEN 'unplaced' ELSE 'skipped' END AS status, event_id % 7 = 0 AS retried, event_type = 'error' AS rejected, (1 + event_id % 3)::INTEGER AS calls, event_id % 4 = 0 AS residual FROM events"


@query(f"""
SELECT user_id, count(*) AS blocks_total, count(*) FILTER (status = 'fit') AS blocks_translated, count(*) FILTER (status <> 'fit') AS blocks_skipped, count(*) FILTER (retried) AS blocks_retried, count(*) FILTER (rejected) AS blocks_rejected, sum(calls)::BIGINT AS api_calls,
  count(*) FILTER (status = 'unplaced') AS blocks_unplaced, count(*) FILTER (residual) AS blocks_residual_source, 0::BIGINT AS blocks_truncated, 0::BIGINT AS blocks_dropped FROM ({_TRIED}) GROUP BY user_id
""")
def direct_stats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when((F.col("value") > 0) & (k % 5 < 3), "fit").when(k % 5 == 3, "unplaced").otherwise("skipped")
    e = table(spark, d, "events").select("user_id", status.alias("status"), (k % 7 == 0).alias("retried"), (F.col("event_type") == "error").alias("rejected"), (1 + k % 3).alias("calls"), (k % 4 == 0).alias("residual"))
    return qa.direct_stats(e, "user_id")


@query("""
SELECT event_id, CASE WHEN coalesce(max(f) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'down' WHEN f = 1 OR event_type = 'signup' THEN 'fallback' ELSE 'first' END AS route
FROM (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events)
""")
def breaker_route(spark: SparkSession, d: str) -> DataFrame:
    return R.route(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "signup").select("event_id", "route")


@query(f"""
WITH l AS (SELECT doc_id, line_no, {S.collapse("line")} AS text FROM {S.LINES} WHERE {S.strip("line")} <> ''),
r AS (SELECT l.doc_id, line_no, text FROM l WHERE {S.letters("text")} >= 2 AND (doc_id + line_no) % 9 <> 0 AND NOT EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = l.doc_id AND line_no % 2 = 0))
SELECT doc_id, count(*) AS residual, sha256(array_to_string(list(left(text, 80) || CASE WHEN length(text) > 80 THEN '…' ELSE '' END ORDER BY line_no)[1:5], '|')) AS samples FROM r GROUP BY doc_id
""")
def residual_blocks(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import lines as L

    l = L.lines(table(spark, d, "documents")).select("doc_id", "line_no", F.col("line").alias("text"), F.regexp_replace("line", r"^[\t ]+$", "").alias("masked"), F.when((F.col("doc_id") + F.col("line_no")) % 9 == 0, "reference").otherwise("line").alias("kind"))
    placed = l.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").where("line_no % 2 = 0").select("doc_id", "line_no")
    return R.residual_blocks(l, placed, ["doc_id", "line_no"]).select("doc_id", "residual", F.sha2(F.array_join("samples", "|"), 256).alias("samples"))


_STATS = "CASE WHEN doc_id % 10 = 9 THEN '{broken' WHEN quality IS NULL THEN NULL ELSE '{\"blocks_rejected\": ' || quality || ', \"segments_rejected\": ' || toxic || ', \"blocks_unplaced\": ' || (doc_id % 4 - 2) || ', \"other\": 5}' END"


@query(f"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 4 - 2 > 0 AND ok THEN 'unplaced_blocks' END, CASE WHEN quality > 0 AND ok THEN 'rejected_blocks' END, CASE WHEN toxic > 0 AND ok THEN 'rejected_segments' END], lambda x: x IS NOT NULL), ',') AS flags
FROM (SELECT d.doc_id, quality, toxic, d.doc_id % 10 <> 9 AND quality IS NOT NULL AS ok FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
""")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.array_join(qa.quality_flags(F.expr(_STATS)), ",").alias("flags"))


@query("""
SELECT count(*) AS jobs, count(*) FILTER (event_type = 'view') AS translated, count(*) FILTER (event_type = 'click') AS copied, count(*) FILTER (event_type IN ('signup')) AS skipped, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 50) AS flagged FROM events
""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    status = F.when(t == "view", "translated").when(t == "click", "copied_source_language").when(t == "signup", "skipped_existing").when(t == "error", "failed").otherwise("pending")
    return qa.run_summary(table(spark, d, "events").select(status.alias("status"), F.when(F.col("value") > 50, F.array(F.lit("rejected_blocks"))).otherwise(F.array().cast("array<string>")).alias("flags")))


_LANGS = ["de", "en", "es", "fr", "mt"]
_FILE = "'f' || doc_id || list_extract(['.doc', '.docx', '.ppt', '.PDF', '.txt'], (doc_id % 5 + 1)::INTEGER)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.concat(F.lit("f"), k.cast("string"), F.get(F.array(*map(F.lit, (".doc", ".docx", ".ppt", ".PDF", ".txt"))), (k % 5).cast("int")))
    return table(spark, d, "documents").select("doc_id", name.alias("filename"), F.col("lang").alias("source_lang"))


@query(f"""
SELECT doc_id, target_lang, 'f' || doc_id || '_' || target_lang || list_extract(['.docx', '.docx', '.pptx', '.PDF', '.txt'], (doc_id % 5 + 1)::INTEGER) AS output_name,
  CASE WHEN doc_id % 6 = 0 AND target_lang = 'fr' THEN 'skipped_existing' WHEN lang = target_lang THEN 'copied_source_language' ELSE 'pending' END AS status
FROM documents CROSS JOIN (VALUES {", ".join(f"('{x}')" for x in _LANGS)}) t(target_lang)
""")
def job_matrix(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    langs = spark.createDataFrame([(x,) for x in _LANGS], "code string")
    done = f.where("doc_id % 6 = 0").select(J.output_name(F.col("filename"), F.lit("fr")).alias("output_name"))
    return J.job_matrix(f, langs, done).select("doc_id", "target_lang", "output_name", "status")


@query(f"SELECT doc_id, {_FILE} AS output_name FROM documents WHERE doc_id % 3 <> 0")
def pending_jobs(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).select("doc_id", F.col("filename").alias("output_name"))
    return J.pending(f, f.where("doc_id % 3 = 0")).select("doc_id", "output_name")


_NAMES = ["a.pdf", "b.TXT", "c.csv", "", "d/e.docx", "g.ppt", "noext"]
_TARGETS = ["fr", " EN-gb", "", "xx", "eng", "ga", "pt"]
_SOURCES = ["en", "", "fr", "de", "zz"]
_ENGINES = ["", "deepl", "llm", "Adaptive", "other"]
_MAPS = ["", '{"a":"b"}', ""]


def _pick(values: list[str], by: int) -> str:
    return f"list_extract([{', '.join(map(S.lit, values))}], (doc_id // {by} % {len(values)} + 1)::INTEGER)"


_REQUESTS = f"SELECT doc_id, {_pick(_NAMES, 1)} AS f, {_pick(_TARGETS, 7)} AS t, {_pick(_SOURCES, 3)} AS s, {_pick(_ENGINES, 2)} AS e, {_pick(_MAPS, 5)} AS m FROM documents"


def _shared(t: str, s: str, e: str) -> str:
    t, s = f"nullif({S.strip(t)}, '')", f"nullif({S.strip(s)}, '')"
    return (
        f"CASE WHEN {S.engine(e)} IS NULL THEN 'engine_unknown' WHEN {S.language_error(t)} IS NOT NULL THEN 'target_' || {S.language_error(t)} WHEN {S.language_error(s)} IS NOT NULL THEN 'source_' || {S.language_error(s)} "
        f"WHEN {S.language_code(t)} = {S.language_code(s)} THEN 'same_language' WHEN {S.engine(e)} = 'deepl' AND {t} IS NOT NULL AND NOT {S.service_supports(t)} THEN 'target_unsupported_by_service' END"
    )


@query(f"""
SELECT doc_id, CASE WHEN f = '' THEN 'file_missing' WHEN NOT {S.among(S.suffix("f"), fixed.DOCUMENT_SUFFIXES)} THEN 'suffix' WHEN {S.strip("t")} = '' THEN 'target_missing' ELSE {_shared("t", "s", "e")} END AS document_error,
  CASE WHEN NOT lower(f) LIKE '%.pdf' THEN 'suffix' WHEN m <> '' AND {S.strip("t")} <> '' THEN 'mapping_and_target' WHEN m = '' AND {S.strip("t")} = '' THEN 'target_missing' ELSE {_shared("t", "s", "e")} END AS pdf_error,
  CASE WHEN NOT {S.among(S.suffix("f"), fixed.DOCUMENT_SUFFIXES)} THEN 'suffix' WHEN {S.suffix("f")} <> '.pdf' THEN CASE WHEN doc_id % 4 = 0 THEN 'html_layout_needs_pdf' WHEN m <> '' THEN 'mapping_needs_pdf' WHEN doc_id % 8 = 1 THEN 'save_html_needs_pdf' WHEN {S.strip("t")} = '' THEN 'target_missing' END
    WHEN doc_id % 4 <> 0 THEN CASE WHEN m <> '' THEN 'mapping_needs_html_layout' WHEN doc_id % 8 = 1 THEN 'save_html_needs_html_layout' WHEN {S.strip("t")} = '' THEN 'target_missing' END
    ELSE CASE WHEN m <> '' AND {S.strip("t")} <> '' THEN 'mapping_and_target' WHEN m = '' AND {S.strip("t")} = '' THEN 'target_missing' END END AS cli_error,
  {S.suffix("f")} AS suffix, {S.stem("f")} AS stem FROM ({_REQUESTS})
""")
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (F.floor(k / by) % len(values)).cast("int"))
    r = table(spark, d, "documents").select("doc_id", pick(_NAMES, 1).alias("f"), pick(_TARGETS, 7).alias("t"), pick(_SOURCES, 3).alias("s"), pick(_ENGINES, 2).alias("e"), pick(_MAPS, 5).alias("m"))
    f, t, s, e, m = (F.col(c) for c in "ftsem")
    return r.select(
        "doc_id", J.document_error(f, t, s, e).alias("document_error"), J.pdf_error(f, t, s, e, m).alias("pdf_error"), J.cli_error(f, t, F.when(k % 4 == 0, "html").otherwise("direct"), m, k % 8 == 1).alias("cli_error"), T.suffix(f).alias("suffix"), T.stem(f).alias("stem"),
    )


@query(f"SELECT DISTINCT code FROM (SELECT lower(trim({_pick(['fr ', 'XX', 'en', 'zz', ''], 1)})) AS code FROM documents) WHERE code <> '' AND NOT {S.among('code', fixed.LANGUAGES)}")
def unsupported_languages(spark: SparkSession, d: str) -> DataFrame:
    c = F.get(F.array(*map(F.lit, ("fr ", "XX", "en", "zz", ""))), (F.col("doc_id") % 5).cast("int"))
    return J.unsupported_languages(table(spark, d, "documents").select(c.alias("code")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return J.upsert(e, ["user_id"], "event_id").select("user_id", "event_type", "event_id")


_CONFIG = """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '  ' WHEN page_id % 3 = 1 THEN ' ' || url || ' ' END AS a, CASE WHEN page_id % 2 = 0 THEN split_part(url, '/', 4) ELSE '' END AS b,
  CASE WHEN page_id % 5 = 4 THEN '  ' ELSE ' ' || url || CASE WHEN page_id % 4 = 1 THEN '/v1' ELSE '' END || repeat('/', (page_id % 3)::INTEGER) END AS c FROM pages"""


@query(f"""
SELECT page_id, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), 'default') AS value, CASE WHEN trim(c) = '' OR regexp_replace(trim(c), '/+$', '') LIKE '%/v1' THEN trim(c) ELSE regexp_replace(trim(c), '/+$', '') || '/v1' END AS url FROM ({_CONFIG})
""")
def config_lookup(spark: SparkSession, d: str) -> DataFrame:
    k, url = F.col("page_id"), F.col("url")
    a, b = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" "), url, F.lit(" "))), F.when(k % 2 == 0, F.split_part(url, F.lit("/"), F.lit(4))).otherwise("")
    c = F.when(k % 5 == 4, "  ").otherwise(F.concat(F.lit(" "), url, F.when(k % 4 == 1, "/v1").otherwise(""), F.repeat(F.lit("/"), (k % 3).cast("int"))))
    return table(spark, d, "pages").select("page_id", T.first_set(a, b, F.lit("default")).alias("value"), T.base_url(c).alias("url"))


_OCR = """SELECT *, l_partkey % 1300 - 150 + 0.5 * (l_linenumber % 2) AS bx1, l_suppkey % 1200 - 100 + 0.25::DOUBLE AS by1, l_partkey % 1300 - 150 + l_orderkey % 400 - 50 + 0.75::DOUBLE AS bx2, l_suppkey % 1200 - 100 + l_partkey % 90 - 10 + 0.5 AS by2 FROM lineitem"""


@query(f"""
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linenumber AS text, {", ".join(f"greatest(0, least(1000, round_even(b{k}, 0)))::INTEGER AS {k}" for k in ("x1", "y1", "x2", "y2"))} FROM ({_OCR}) WHERE l_linenumber <> 4 AND l_linenumber <> 6) WHERE x2 > x1 AND y2 > y1
""")
def ocr_rows(spark: SparkSession, d: str) -> DataFrame:
    """Replies about one image each: a block with a box worked out from the row, blank in every fourth line, of three numbers in every sixth."""
    line = F.col("l_linenumber")
    x1, y1 = F.col("l_partkey") % 1300 - 150 + 0.5 * (line % 2), F.col("l_suppkey") % 1200 - 100 + 0.25
    box = F.array(x1, y1, F.col("l_partkey") % 1300 - 150 + F.col("l_orderkey") % 400 - 50 + 0.75, F.col("l_suppkey") % 1200 - 100 + F.col("l_partkey") % 90 - 10 + 0.5)
    text = F.when(line == 4, " \n").otherwise(F.concat(F.lit(" "), "l_returnflag", line.cast("string"), F.lit(" ")))
    block = F.struct(text.alias("text"), F.when(line == 6, F.slice(box, 1, 3)).otherwise(box).alias("bbox"))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(block).alias("blocks"))), F.lit("\n```"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(ocr_blocks(reply)).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


def ocr_blocks(reply):
    """array<struct<text, x1, y1, x2, y2>> of a reply: boxes of four numbers, clamped to 0 to 1000, not empty, with text."""
    fenced = F.regexp_extract(T.strip(reply), r"(?s)```(?:json)?[ \t\r\n]*(\{.*\})[ \t\r\n]*```", 1)
    body = F.when(fenced != "", fenced).otherwise(T.strip(reply))
    parsed = F.from_json(body, "blocks array<struct<text:string,bbox:array<double>>>")
    edge = lambda b, i: F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(F.get(b["bbox"], F.lit(i)), 0))).cast("int")
    rows = F.transform(F.filter(parsed["blocks"], lambda b: (T.strip(b["text"]) != "") & (F.size(b["bbox"]) == 4)), lambda b: F.struct(T.strip(b["text"]).alias("text"), *[edge(b, i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]))
    return F.filter(rows, lambda r: (r["x2"] > r["x1"]) & (r["y2"] > r["y1"]))


_SUFFIXES = [".txt", ".PDF", ".csv", ".docx", "", ".ppt", ".md", ".pptx.bak", ".Doc"]


@query(f"""
SELECT doc_id, path FROM (SELECT doc_id, 'in/' || coalesce(source, 'none') || '/' || lang || '.' || doc_id || list_extract([{", ".join(map(S.lit, _SUFFIXES))}], (doc_id % {len(_SUFFIXES)} + 1)::INTEGER) AS path FROM documents) WHERE {S.among(S.suffix("path"), fixed.DOCUMENT_SUFFIXES)}
""")
def directory_scan(spark: SparkSession, d: str) -> DataFrame:
    """The supported files of a folder with one for each document, in order."""
    kind = F.get(F.array(*map(F.lit, _SUFFIXES)), (F.col("doc_id") % len(_SUFFIXES)).cast("int"))
    path = F.concat(F.lit("in/"), F.coalesce("source", F.lit("none")), F.lit("/"), "lang", F.lit("."), F.col("doc_id").cast("string"), kind)
    return J.discover(table(spark, d, "documents").select("doc_id", path.alias("path")))


@query("SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"n_chars\":' || n_chars || ',\"stats_kind\":\"text\"}' AS sidecar FROM documents")
def stats_sidecar(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", "n_chars")
    return s.select("doc_id", qa.sidecar(s, "text").alias("sidecar"))


_CODE_IN = r"(?i:(?:^|[^\p{L}\p{N}_])([a-z][a-z])(?:[-_][a-z][a-z])?(?:$|[^\p{L}\p{N}_]))"


@query(f"""
SELECT doc_id, coalesce(nullif(lower(regexp_extract(a, {S.lit(_CODE_IN)}, 1)), ''), nullif(lower(regexp_extract(b, {S.lit(_CODE_IN)}, 1)), '')) AS code
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(lang) || '_XX' WHEN 1 THEN 'language' || lang WHEN 2 THEN '(' || lang || ')' END AS a, text AS b FROM documents)
""")
def metadata_language(spark: SparkSession, d: str) -> DataFrame:
    """A field with the language in some form, or none, before the text itself."""
    k, lang = F.col("doc_id") % 4, F.col("lang")
    a = F.when(k == 0, F.concat(F.upper(lang), F.lit("_XX"))).when(k == 1, F.concat(F.lit("language"), lang)).when(k == 2, F.concat(F.lit("("), lang, F.lit(")")))
    return table(spark, d, "documents").select("doc_id", T.metadata_language(a, F.col("text")).alias("code"))


@query("""
SELECT user_id, count(DISTINCT event_id // 10) AS image_regions_processed, count(*) FILTER (event_type = 'view') AS image_blocks_translated, count(*) FILTER (event_type = 'error') AS image_blocks_rejected, sum(1 + event_id % 2)::BIGINT AS api_calls FROM events GROUP BY user_id
""")
def image_stats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, d, "events").select("user_id", F.floor(k / 10).alias("region"), (F.col("event_type") == "view").alias("placed"), (F.col("event_type") == "error").alias("rejected"), (1 + k % 2).alias("calls"))
    return qa.image_stats(e, "user_id")


_NAMED = ["a.PDF", "b c.txt", "ünï.docx", "x.pptx", "y.doc", "z.ppt", "q.xyz"]
_FONTS = ["Arial-BoldItalic", "TimesBd", "HelveticaOblique", "Plain", "Georgiait"]


@query(f"""
SELECT doc_id, CASE {" ".join(f"WHEN lower(f) LIKE '%{k}' THEN '{v}'" for k, v in sorted(fixed.MEDIA_TYPES.items(), key=lambda x: -len(x[0])))} ELSE 'application/octet-stream' END AS media_type,
  {S.sub(S.stem("f"), r"[^\p{L}\p{N}_-]", "_")} AS safe, CASE doc_id % 5 WHEN 0 THEN 'hebi' WHEN 1 THEN 'hebo' WHEN 2 THEN 'heit' WHEN 3 THEN 'helv' ELSE 'heit' END AS font
FROM (SELECT doc_id, list_extract([{", ".join(map(S.lit, _NAMED))}], (doc_id % 7 + 1)::INTEGER) AS f FROM documents)
""")
def file_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    f = F.get(F.array(*map(F.lit, _NAMED)), (k % 7).cast("int"))
    font = F.get(F.array(*map(F.lit, _FONTS)), (k % 5).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.media_type(f).alias("media_type"), T.safe_stem(f).alias("safe"), T.base_font(font).alias("font"))


@query("""
SELECT conv_id, turn, 'Translate from en to fr. Return only the translation:' || chr(10) || chr(10) || text AS single, sha256('Translate from en to fr. Reply with JSON only.' || chr(10) || chr(10) || '{' || chr(10) || '  "' || turn || '": ' || to_json(text)::VARCHAR || chr(10) || '}') AS batch FROM conversations
""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    s, t = F.lit("en"), F.lit("fr")
    return table(spark, d, "conversations").select("conv_id", "turn", T.prompt(s, t, F.col("text")).alias("single"), F.sha2(T.batch_prompt(s, t, F.array("turn"), F.array("text")), 256).alias("batch"))
