"""URL filter with a temporal list join. DataFrame functions only.

The list is a log: at some time a pattern was added with a verdict, or removed. A pattern's entries become validity intervals, each
ending where the pattern's next entry begins. A capture is judged by the entries active when it was fetched: its host, the host's
parent domains and its leading path segments are looked up, and the longest active pattern decides. The as-of join is an equi-join
on (pattern, month) with the interval as residual condition: intervals are split at months, so a pattern with a long history is
compared with few versions, and a host with very many captures is spread over the months (and can be split further by the engine).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

END = "9999-12-31 00:00:00"


def intervals(log: DataFrame) -> DataFrame:
    """(pattern, verdict, since, until) from the log (pattern, op 'add' or 'remove', verdict 'block' or 'allow', at).

    Of entries of a pattern at the same time the last one counts, remove after add and block after allow. Rows with a null
    pattern, op or time are left out; patterns are compared in lower case.
    """
    w = Window.partitionBy("pattern").orderBy("at")
    log = log.select(F.lower("pattern").alias("pattern"), "op", "verdict", F.col("at").cast("timestamp").alias("at")).where("pattern is not null and op is not null and at is not null")
    last = log.groupBy("pattern", "at").agg(F.max(F.struct("op", "verdict")).alias("x")).select("pattern", "at", "x.op", "x.verdict")
    spans = last.withColumn("until", F.coalesce(F.lead("at").over(w), F.to_timestamp(F.lit(END)))).where("op = 'add'")
    return spans.select("pattern", "verdict", F.col("at").alias("since"), "until")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def lookups(url: Column, deepest: Column) -> Column:
    """Patterns that a URL can be listed by: its host, the host's parent domains, the host with up to `deepest` leading path segments."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.slice(F.filter(F.split(F.lower(path), "/"), lambda s: s != ""), F.lit(1), deepest)
    n = F.size(parts)
    paths = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(domains, paths))


#: Listed versions up to so many (a few MB) are made known to all tasks; more are met by a shuffle.
KNOWN = 50_000


def judge(captures: DataFrame, log: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, host, n_active, pattern, verdict) for every capture row (page_id, url, fetched_at).

    n_active counts the active listed patterns that name the capture, pattern is the longest (of equal ones the first by name;
    null if none), verdict its verdict or 'allow'. A null or unparsable URL has an empty host and is named by nothing; a null
    fetch time meets no interval; a repeated row is a capture like any other; an empty table gives no rows and an empty list
    allows everything; other columns are ignored.
    """
    month = lambda c: F.date_trunc("month", c)
    spans = intervals(log)
    # The open end would make very many months: open intervals go to month null, which every capture looks up as well.
    closed = spans.where(F.col("until") < F.to_timestamp(F.lit(END)))
    closed = closed.select("*", F.explode(F.sequence(month("since"), month("until"), F.expr("interval 1 month"))).alias("month"))
    spans = closed.unionByName(spans.where(F.col("until") >= F.to_timestamp(F.lit(END))).withColumn("month", F.lit(None).cast("timestamp")))
    spans = checkpointed(spans.select(F.xxhash64("pattern", "month").alias("key2"), F.col("pattern").alias("listed"), "verdict", "since", "until"))
    n, deepest = spans.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("listed", "/")) - 1), F.lit(0))).first()
    few = n <= KNOWN
    # Rows are numbered and written down once, so that a hit finds its row again whatever the row holds.
    c = checkpointed(captures.select("page_id", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"), F.monotonically_increasing_id().alias("row")))
    named = c.where(host_of(F.col("url")) != "").select("row", "fetched_at", F.explode(lookups(F.col("url"), F.lit(deepest))).alias("named"))
    if not few:  # a lookup goes on only if its pattern is listed at all; each pattern is there once
        listed = spans.select(F.xxhash64("listed").alias("name2")).distinct()
        named = named.withColumn("name", F.xxhash64("named")).join(listed, F.col("name") == F.col("name2"), "left_semi").drop("name")
    keys = named.withColumn("m", F.explode(F.array(month("fetched_at"), F.lit(None).cast("timestamp")))).withColumn("key", F.xxhash64("named", "m"))
    hit = (F.col("key") == F.col("key2")) & (F.col("named") == F.col("listed")) & (F.col("since") <= F.col("fetched_at")) & (F.col("fetched_at") < F.col("until"))
    found = keys.join(F.broadcast(spans) if few else spans, hit).groupBy(F.col("row").alias("row2")).agg(
        F.countDistinct("listed").alias("n_active"),
        F.min(F.struct((-F.length("listed")).alias("n"), F.col("listed").alias("pattern"), F.col("verdict").alias("verdict"))).alias("best"),
    )
    out = c.join(found, F.col("row") == F.col("row2"), "left")
    return out.select("page_id", "url", "fetched_at", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"), "best.pattern", F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list for tables that bring none: (pattern, op, verdict, at) worked out from the hosts, parent domains and first paths of URLs.

    The digits of a pattern's MD5 say whether it is listed, when and as what, whether it is removed and when it is added again.
    """
    url = F.col("url")
    host = host_of(url)
    patterns = F.array_distinct(F.array(host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.concat(host, F.lit("/"), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)))))
    p = pages.where(host != "").select(F.explode(patterns).alias("pattern")).where("pattern <> '' and not endswith(pattern, '/')").distinct()
    digits = lambda a, n: F.conv(F.substring(F.md5("pattern"), a, n), 16, 10).cast("int")
    after = lambda minutes: F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=minutes)
    first, verdict = digits(3, 4) * 8, F.when(digits(7, 1) < 11, "block").otherwise("allow")
    row = lambda op, v, at: F.struct(F.lit(op).alias("op"), v.alias("verdict"), after(at).alias("at"))
    added, removed = row("add", verdict, first), row("remove", F.lit(None).cast("string"), first + digits(9, 3) * 60)
    again = row("add", F.lit("block"), first + F.lit(4096 * 60) + digits(13, 3))
    entries = F.array_compact(F.array(added, F.when(digits(8, 1) < 12, removed), F.when(digits(12, 1) < 6, again)))
    return p.where(digits(1, 2) < 64).select("pattern", F.explode(entries).alias("e")).select("pattern", "e.*")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a dated list of their hosts and paths; the table has neither, so both are worked out from what it holds."""
    fetched = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(page_id * 7919 % 527040 as int), 0)")
    pages = table(spark, sf_dir, "pages")
    found = judge(pages.select("page_id", "url", fetched.alias("fetched_at")), dated_list(pages))
    return found.select("page_id", "url", "host", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "n_active", "pattern", "verdict")


_DIGITS = "('0x' || substring(md5(pattern), {}, {}))::INTEGER"
OP2_SQL = f"""
WITH c AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1)), '/'), lambda s: s <> '') AS parts,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)) AS first_part,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id * 7919 % 527040) AS t, row_number() OVER () AS r
  FROM pages
), p AS (
  SELECT DISTINCT pattern FROM (
    SELECT host AS pattern FROM c UNION ALL SELECT regexp_extract(host, '([^.]+[.][^.]+)$', 1) FROM c UNION ALL SELECT host || '/' || first_part FROM c WHERE host <> ''
  ) WHERE pattern <> '' AND NOT ends_with(pattern, '/')
), d AS (
  SELECT pattern, {_DIGITS.format(3, 4)} * 8 AS first, CASE WHEN {_DIGITS.format(7, 1)} < 11 THEN 'block' ELSE 'allow' END AS verdict, {_DIGITS.format(9, 3)} * 60 AS stay,
    {_DIGITS.format(8, 1)} < 12 AS removed, {_DIGITS.format(12, 1)} < 6 AS again, 4096 * 60 + {_DIGITS.format(13, 3)} AS later
  FROM p WHERE {_DIGITS.format(1, 2)} < 64
), log AS (
  SELECT pattern, 'add' AS op, verdict, first AS m FROM d UNION ALL SELECT pattern, 'remove', NULL, first + stay FROM d WHERE removed UNION ALL SELECT pattern, 'add', 'block', first + later FROM d WHERE again
), one AS (
  SELECT pattern, m, max(op) AS op, CASE WHEN max(op) = 'add' THEN max(verdict) FILTER (op = 'add') END AS verdict FROM log GROUP BY pattern, m
), spans AS (
  SELECT pattern, op, verdict, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(m) AS since,
    coalesce(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(lead(m) OVER (PARTITION BY pattern ORDER BY m)), TIMESTAMP '{END}') AS until FROM one
), labels AS (SELECT *, string_split(host, '.') AS l FROM c WHERE host <> ''),
names AS (
  SELECT r, t, unnest(list_distinct(list_concat(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.')), list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/'))))) AS name FROM labels
), best AS (
  SELECT r, count(DISTINCT pattern) AS n, arg_min(pattern, (-length(pattern), pattern)) AS pattern, arg_min(verdict, (-length(pattern), pattern)) AS verdict
  FROM names JOIN spans s ON name = pattern AND s.op = 'add' AND s.since <= t AND t < s.until GROUP BY r
)
SELECT c.page_id, c.url, c.host, strftime(c.t, '%Y-%m-%d %H:%M:%S') AS fetched_at, coalesce(b.n, 0)::BIGINT AS n_active, b.pattern, coalesce(b.verdict, 'allow') AS verdict
FROM c LEFT JOIN best b USING (r)
"""
