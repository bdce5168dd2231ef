"""Queries over page layout. There is no table of boxes, so lines get places by integer arithmetic, the same in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import predicates as P
from ..functions import text as T
from ..functions import widths as M
from ..operators import boxes as B
from ..operators import layout as Y
from ..operators import lines as L
from ..operators import qa
from . import sql as S
from .registry import query, table

_SPLIT = r"\n|\. "
# One row a line or sentence, k to a document, 40 to a page; even documents have two columns with wide lines between.
_PIECES = f"SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS text FROM (SELECT doc_id, string_split_regex(text, {S.lit(_SPLIT)}) AS l FROM documents)"
_PLACED = f"""
SELECT doc_id, (k // 40)::INTEGER AS page_index, (k % 40)::INTEGER AS line_id, k::INTEGER AS k, text, m,
  CASE WHEN doc_id % 2 = 0 AND k % 20 <> 0 AND k % 2 = 1 THEN 320.0 WHEN doc_id % 2 = 0 THEN 40.0 ELSE 40.0 + (m % 3) * 8.25 END::DOUBLE AS x0,
  CASE WHEN doc_id % 2 = 0 AND k % 20 = 0 THEN 500.0 WHEN doc_id % 2 = 0 THEN 200.0 + (m % 5) * 2.5 ELSE 300.0 + (m % 11) * 10.25 END::DOUBLE AS w,
  CASE WHEN doc_id % 2 = 0 AND k % 20 = 0 THEN 30.0 + (k % 40) * 7.5 - 10 WHEN doc_id % 2 = 0 THEN 150.0 + (k % 40 // 2) * 12.5 ELSE 150.0 + (k % 40) * 12.5 END::DOUBLE AS y0,
  (10.0 + (m % 2) * 0.25)::DOUBLE AS font_size, CASE WHEN m % 13 = 0 THEN 255 ELSE 0 END::INTEGER AS color, (k // 10)::INTEGER AS raw_block_id
FROM (SELECT *, (doc_id * 31 + k * 17) AS m FROM ({_PIECES}))
"""
_BOXES = f"SELECT *, x0 + w AS x1, y0 + 11.25 AS y1 FROM ({_PLACED})"


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Lines with boxes (schema.LINE, and k, m, w)."""
    # Outer, as the optimizer would make a filter of the other kind, which splits all texts once more.
    l = table(spark, d, "documents").select("doc_id", F.posexplode_outer(F.split("text", _SPLIT, -1)).alias("k", "text")).where("k is not null")
    k, two, m = F.col("k"), F.col("doc_id") % 2 == 0, F.col("m")
    wide = two & (k % 20 == 0)
    row = k % 40
    l = l.withColumn("m", F.col("doc_id") * 31 + k * 17).select(
        "doc_id", F.floor(k / 40).cast("int").alias("page_index"), row.cast("int").alias("line_id"), "k", "text", "m",
        F.when(two & ~wide & (k % 2 == 1), 320.0).when(two, 40.0).otherwise(40.0 + (m % 3) * 8.25).alias("x0"),
        F.when(wide, 500.0).when(two, 200.0 + (m % 5) * 2.5).otherwise(300.0 + (m % 11) * 10.25).alias("w"),
        F.when(wide, 30.0 + row * 7.5 - 10).when(two, 150.0 + F.floor(row / 2) * 12.5).otherwise(150.0 + row * 12.5).alias("y0"),
        (10.0 + (m % 2) * 0.25).alias("font_size"), F.when(m % 13 == 0, 255).otherwise(0).alias("color"), F.floor(k / 10).cast("int").alias("raw_block_id"),
    )
    return l.select(
        "*", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + 11.25).alias("y1"), F.lit(600.0).alias("page_width"), F.lit("helv").alias("font_name"), F.lit(0).alias("rotation"), F.lit(1.0).alias("confidence"),
        G.rgb(F.col("color")).getField("r").alias("r"), G.rgb(F.col("color")).getField("g").alias("g"), G.rgb(F.col("color")).getField("b").alias("b"),
    )


_COLUMNS = f"""
SELECT *, CASE WHEN multi AND w < 360 AND NOT (y0 < 168 AND w >= 240) THEN CASE WHEN (x0 + x1) / 2 < 300 THEN 0 ELSE 1 END END AS column_index
FROM (SELECT *, count(*) OVER p >= 16 AND (count(*) FILTER (w < 360) OVER p) >= 12 AND (count(*) FILTER (w < 360 AND (x0 + x1) / 2 < 300) OVER p) >= 5
  AND (count(*) FILTER (w < 360 AND (x0 + x1) / 2 >= 300) OVER p) >= 5 AND coalesce((avg(w) FILTER (w < 360) OVER p) <= 252, false) AS multi
FROM ({_BOXES}) WINDOW p AS (PARTITION BY doc_id, page_index))
"""


@query(f"""
WITH z AS (SELECT *, CASE WHEN NOT multi OR top IS NULL THEN 0 WHEN column_index = 0 THEN 1 WHEN column_index = 1 THEN 2 WHEN y0 < top - 6 THEN 0 WHEN y0 > bottom + 6 THEN 4 ELSE 3 END AS zone
  FROM (SELECT *, min(CASE WHEN column_index IS NOT NULL THEN y0 END) OVER p AS top, max(CASE WHEN column_index IS NOT NULL THEN y1 END) OVER p AS bottom FROM ({_COLUMNS}) WINDOW p AS (PARTITION BY doc_id, page_index)))
SELECT doc_id, page_index, line_id, column_index, (row_number() OVER (PARTITION BY doc_id, page_index ORDER BY zone, round_even(y0, 1), round_even(x0, 1), line_id) - 1)::INTEGER AS order_no FROM z
""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return Y.reading_order(Y.detect_columns(placed(spark, d))).select("doc_id", "page_index", "line_id", "column_index", "order_no")


@query(f"""
WITH f AS (SELECT doc_id, raw_block_id, k // 2 AS row_no, x0, x1, font_size AS size, CASE WHEN color = 255 THEN 1.0 ELSE 0.0 END AS b, k FROM (SELECT *, 40.0 + (k % 2) * (140.0 + (m % 40)) AS x0, 40.0 + (k % 2) * (140.0 + (m % 40)) + 130.0 AS x1 FROM ({_PLACED.replace(" AS x0,", " AS x00,")}))),
n AS (SELECT *, lead(x0) OVER w AS nx, lead(size) OVER w AS ns, lead(b) OVER w AS nb FROM f WINDOW w AS (PARTITION BY doc_id, row_no ORDER BY x0, k))
SELECT doc_id, row_no::BIGINT AS row_no, count(*) AS fragments, bool_and(nx IS NULL OR NOT (nx - x1 < -1 OR nx - x1 > 3 * greatest(size, ns, 1.0) OR abs(size - ns) > 0.25 * greatest(size, ns) OR abs(b - nb) > 0.2)) AS stitchable FROM n GROUP BY doc_id, row_no
""")
def row_stitch_test(spark: SparkSession, d: str) -> DataFrame:
    side = F.col("k") % 2
    p = placed(spark, d).withColumn("x0", 40.0 + side * (140.0 + F.col("m") % 40)).withColumn("x1", F.col("x0") + 130.0)
    f = p.select("doc_id", F.floor(F.col("k") / 2).alias("row_no"), F.col("k").alias("frag_no"), "x0", "x1", F.col("font_size").alias("size"), "r", "g", "b")
    return Y.stitchable_rows(f, ["doc_id", "row_no"])


_HEADED = f"SELECT doc_id, k::INTEGER AS k, CASE WHEN k = 3 + doc_id % 7 THEN 'References:' ELSE text END AS text FROM ({_PIECES})"


@query(f"""
SELECT doc_id, k, coalesce(k >= min(CASE WHEN {S.reference_heading("text")} AND k >= n // 2 THEN k END) OVER (PARTITION BY doc_id), false) AS is_reference
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_HEADED}))
""")
def reference_section(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", _SPLIT, -1)).alias("k", "text"))
    l = l.withColumn("text", F.when(F.col("k") == 3 + F.col("doc_id") % 7, "References:").otherwise(F.col("text")))
    return Y.mark_references(l, ["k"]).select("doc_id", "k", "is_reference")


@query(f"""
SELECT doc_id, page_index, line_id, CASE WHEN {S.collapse("t")} = '' THEN generic WHEN {S.table_row(S.collapse("t"))} THEN 'table' WHEN lower({S.collapse("t")}) LIKE 'abstract%' THEN 'abstract' WHEN lower({S.collapse("t")}) LIKE 'keyword%' THEN 'keywords'
  WHEN lower({S.collapse("t")}) LIKE 'references%' THEN 'reference' WHEN regexp_matches(lower({S.collapse("t")}), '^(?:fig\\.|figure |table )') THEN 'caption'
  WHEN w >= 270 AND ((y0 < 120 AND font_size >= 14) OR (y0 < 120 AND font_size >= 36)) THEN 'title' WHEN line_count > 1 THEN 'paragraph' ELSE generic END AS kind
FROM (SELECT *, CASE WHEN {S.like("t", S.T.BULLET)} THEN 'bullet' WHEN {S.strip("t")} LIKE '%:' AND line_count = 1 THEN 'label' WHEN line_count > 1 THEN 'paragraph' ELSE 'line' END AS generic
  FROM (SELECT doc_id, page_index, line_id, w, y0, CASE WHEN m % 5 = 0 THEN 20.0 ELSE font_size END AS font_size, (1 + m % 2) AS line_count,
    list_extract(['', 'Abstract ', 'Keywords: ', 'References ', 'Fig. 1 ', '- ', 'Table 3 ', '5 mg of '], (m % 8 + 1)::INTEGER) || text || CASE WHEN m % 9 = 0 THEN ':' ELSE '' END AS t FROM ({_BOXES})))
""")
def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("m")
    t = F.concat(F.get(F.array(*map(F.lit, ("", "Abstract ", "Keywords: ", "References ", "Fig. 1 ", "- ", "Table 3 ", "5 mg of "))), (m % 8).cast("int")), "text", F.when(m % 9 == 0, ":").otherwise(""))
    p = placed(spark, d)
    kind = Y.block_kind(t, 1 + m % 2, F.col("y0"), F.when(m % 5 == 0, 20.0).otherwise(F.col("font_size")), F.col("page_width"), F.col("w"))
    return p.select("doc_id", "page_index", "line_id", kind.alias("kind"))


# Blocks of four lines, whose left edges, right edges or centres line up, by document.
_ALIGNED = f"""
SELECT doc_id, (k // 4)::INTEGER AS block_no, k, text, y0, y1, CASE doc_id % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 500.0 - u ELSE 300.0 - u / 2 END::DOUBLE AS x0, CASE doc_id % 3 WHEN 0 THEN 100.0 + u WHEN 1 THEN 500.0 ELSE 300.0 + u / 2 END::DOUBLE AS x1
FROM (SELECT *, 200.0 + (m % 8) * 12.5 AS u FROM ({_BOXES}))
"""


@query(f"""
WITH b AS (SELECT doc_id, block_no, count(*) AS n, max(x0) - min(x0) AS l, max(x1) - min(x1) AS r, max((x0 + x1) / 2) - min((x0 + x1) / 2) AS c, list_sort(list(x0)) AS xs, arg_min(text, k) AS t,
  min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({_ALIGNED}) GROUP BY doc_id, block_no)
SELECT doc_id, block_no, n AS members, x0, y0, x1, y1, CASE WHEN n < 2 THEN 'left' WHEN l > 6 AND c <= greatest(3.0, l * 0.25) THEN 'center'
  WHEN n >= 3 AND r <= 2.5 AND l > 6 AND c > r AND NOT {S.like("t", S.T.BULLET)} AND xs[-1] - xs[2] > 4 THEN 'right' ELSE 'left' END AS alignment FROM b
""")
def block_alignment(spark: SparkSession, d: str) -> DataFrame:
    p, m = placed(spark, d), F.col("m")
    u, side = 200.0 + (m % 8) * 12.5, F.col("doc_id") % 3
    p = p.withColumn("block_no", F.floor(F.col("k") / 4).cast("int")).withColumn("x0", F.when(side == 0, 100.0).when(side == 1, 500.0 - u).otherwise(300.0 - u / 2)).withColumn("x1", F.when(side == 0, 100.0 + u).when(side == 1, 500.0).otherwise(300.0 + u / 2))
    boxes = qa.bounding_boxes(p, ["doc_id", "block_no"])
    lines = p.groupBy("doc_id", "block_no").agg(F.collect_list(F.struct("x0", "x1")).alias("boxes"), F.min_by("text", "k").alias("t"))
    return boxes.join(lines, ["doc_id", "block_no"]).select("doc_id", "block_no", "members", "x0", "y0", "x1", "y1", Y.alignment(F.col("boxes"), F.col("t")).alias("alignment"))


@query()
def block_merge(spark: SparkSession, d: str) -> DataFrame:
    """Lines merged to blocks in reading order."""
    lines = Y.reading_order(Y.detect_columns(placed(spark, d).where(P.native_text(F.col("text")))))
    return Y.blocks(lines, hyphens=False).select("doc_id", "page_index", "block_no", F.length("text").cast("long").alias("text_len"), "line_count", "kind", "alignment")


@query()
def hyphen_merge(spark: SparkSession, d: str) -> DataFrame:
    """As block_merge, with words that lines break off joined across blocks."""
    broken = placed(spark, d).withColumn("text", F.when(F.col("m") % 3 == 0, F.concat(T.rstrip(F.col("text")), F.lit("-"))).otherwise(F.lower("text")))
    return Y.blocks(Y.reading_order(Y.detect_columns(broken))).select("doc_id", "page_index", "block_no", F.length("text").cast("long").alias("text_len"), "line_count")


@query(f"""
WITH RECURSIVE b AS (SELECT doc_id, page_index, line_id, y0, y1 FROM ({_BOXES})),
r(doc_id, page_index, line_no, heads, row_no) AS (
  SELECT doc_id, page_index, 0, [{{'y0': y0, 'y1': y1}}], 0 FROM b WHERE line_id = 0
  UNION ALL SELECT r.doc_id, r.page_index, r.line_no + 1, CASE WHEN place IS NULL THEN list_append(r.heads, {{'y0': b.y0, 'y1': b.y1}}) ELSE r.heads END, coalesce(place - 1, len(r.heads))
  FROM r JOIN b ON b.doc_id = r.doc_id AND b.page_index = r.page_index AND b.line_id = r.line_no + 1,
    LATERAL (SELECT list_position(list_transform(r.heads, lambda h: greatest(0.0, least(h.y1, b.y1) - greatest(h.y0, b.y0)) / greatest(1.0, least(h.y1 - h.y0, b.y1 - b.y0)) >= 0.6), true) AS place) l)
SELECT doc_id, page_index, line_no::INTEGER AS line_no, row_no::INTEGER AS row_no FROM r
""")
def row_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Rows of lines by overlapping heights."""
    pages = placed(spark, d).groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("line_id", "y0", "y1"))).alias("b"))
    return pages.select("doc_id", "page_index", F.posexplode(Y.cluster_rows(F.transform("b", lambda x: F.struct(x["y0"].alias("y0"), x["y1"].alias("y1"))))).alias("line_no", "row_no"))


_SAME = "abs(b.x0 - o.x0) <= 0.5 AND abs(b.y0 - o.y0) <= 0.5 AND abs(b.x1 - o.x1) <= 0.5 AND abs(b.y1 - o.y1) <= 0.5"


@query(f"""
WITH b AS (SELECT doc_id, page_index, line_id AS block_id, x0, y0, x1, y1, font_size FROM ({_BOXES}))
SELECT b.doc_id, b.page_index, b.block_id, greatest(any_value(b.y0) + 10, least(840.0, coalesce(min(o.y0) - 1, 842.0))) AS vertical_limit
FROM b LEFT JOIN b o ON b.doc_id = o.doc_id AND b.page_index = o.page_index AND o.y0 > b.y0 + greatest(4.0, b.font_size * 0.6) AND least(b.x1, o.x1) - greatest(b.x0, o.x0) > least(b.x1 - b.x0, o.x1 - o.x0) * 0.30 AND NOT ({_SAME})
GROUP BY b.doc_id, b.page_index, b.block_id
""")
def obstacle_below(spark: SparkSession, d: str) -> DataFrame:
    b = placed(spark, d).withColumn("block_id", F.col("line_id"))
    return Y.room_below(b, b)


@query(f"""
WITH b AS (SELECT doc_id, page_index, line_id AS block_id, x0, y0, x1, y1 FROM ({_BOXES}))
SELECT b.doc_id, b.page_index, b.block_id, greatest(2.0, coalesce(max(o.x1 + 2) FILTER (o.x1 <= b.x0), 2.0)) AS left_limit, least(598.0, coalesce(min(o.x0 - 2) FILTER (o.x1 > b.x0 AND o.x0 >= b.x1), 600.0)) AS right_limit
FROM b LEFT JOIN b o ON b.doc_id = o.doc_id AND b.page_index = o.page_index AND least(b.y1, o.y1) - greatest(b.y0, o.y0) > 0.5 AND NOT ({_SAME})
GROUP BY b.doc_id, b.page_index, b.block_id
""")
def side_clearance(spark: SparkSession, d: str) -> DataFrame:
    b = placed(spark, d).withColumn("block_id", F.col("line_id"))
    return Y.room_beside(b, b)


@query(f"""
WITH RECURSIVE b AS (SELECT doc_id, page_index, line_id AS block_id, x0, y0, x1, y1 FROM ({_BOXES})),
a AS (SELECT doc_id, page_index, block_id // 5 AS n, x0, y0, x1, y1 FROM b WHERE block_id % 5 = 0),
r(doc_id, page_index, block_id, n, x0, y0, x1, y1) AS (
  SELECT doc_id, page_index, block_id, 0, x0, y0 - 2.0, x1, y1 + 5.0 FROM b WHERE block_id % 5 <> 0
  UNION ALL SELECT r.doc_id, r.page_index, r.block_id, r.n + 1,
    CASE WHEN hit AND NOT stacked AND side AND NOT (r.x0 < a.x0 AND a.x0 < r.x1) AND r.x0 < a.x1 AND a.x1 < r.x1 THEN greatest(r.x0, a.x1 + 0.25) ELSE r.x0 END,
    CASE WHEN hit AND stacked AND NOT (r.y0 < a.y0 AND a.y0 < r.y1) AND r.y0 < a.y1 AND a.y1 < r.y1 THEN greatest(r.y0, a.y1 + 0.25) ELSE r.y0 END,
    CASE WHEN hit AND NOT stacked AND side AND r.x0 < a.x0 AND a.x0 < r.x1 THEN least(r.x1, a.x0 - 0.25) ELSE r.x1 END,
    CASE WHEN hit AND stacked AND r.y0 < a.y0 AND a.y0 < r.y1 THEN least(r.y1, a.y0 - 0.25) ELSE r.y1 END
  FROM r JOIN a ON a.doc_id = r.doc_id AND a.page_index = r.page_index AND a.n = r.n,
    LATERAL (SELECT greatest(0.0, least(r.x1, a.x1) - greatest(r.x0, a.x0)) AS across, greatest(0.0, least(r.y1, a.y1) - greatest(r.y0, a.y0)) AS down) o,
    LATERAL (SELECT across > 0 AND down > 0 AS hit, across / greatest(1.0, least(r.x1 - r.x0, a.x1 - a.x0)) >= 0.25 AS stacked, down / greatest(1.0, least(r.y1 - r.y0, a.y1 - a.y0)) >= 0.25 AS side) t),
f AS (SELECT r.* FROM r LEFT JOIN a ON a.doc_id = r.doc_id AND a.page_index = r.page_index AND a.n = r.n WHERE a.n IS NULL)
SELECT doc_id, page_index, block_id, x0, y0, x1, y1 FROM f
""")
def redaction_trim(spark: SparkSession, d: str) -> DataFrame:
    """Boxes grown a little and cut back from every fifth line's box."""
    b = placed(spark, d).withColumn("block_id", F.col("line_id"))
    grown = b.withColumn("y1", F.col("y1") + 5.0).withColumn("y0", F.col("y0") - 2.0)
    return Y.trim_redactions(grown.where("block_id % 5 <> 0"), b.where("block_id % 5 = 0")).drop("usable")


@query(f"""
WITH b AS (SELECT doc_id, page_index, line_id AS block_id, x0, y0, x1, y1 FROM ({_BOXES}))
SELECT b.doc_id, b.page_index, b.block_id, o.block_id AS other FROM b JOIN b o ON b.doc_id = o.doc_id AND b.page_index = o.page_index AND b.block_id % 5 <> 0 AND o.block_id % 5 = 0 AND least(b.x1, o.x1) > greatest(b.x0, o.x0) AND least(b.y1 + 5.0, o.y1) > greatest(b.y0 - 2.0, o.y0)
""")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Boxes grown a little and the boxes of every fifth line that they overlap."""
    b = placed(spark, d).select("doc_id", "page_index", F.col("line_id").alias("block_id"), "x0", "y0", "x1", "y1")
    grown = b.where("block_id % 5 <> 0").withColumn("y0", F.col("y0") - 2.0).withColumn("y1", F.col("y1") + 5.0)
    met = B.meeting(grown, b.where("block_id % 5 = 0"), Y.PAGE)
    over = [G.overlap(F.col(f"{k}0"), F.col(f"{k}1"), F.col(f"o_{k}0"), F.col(f"o_{k}1")) > 0 for k in "xy"]
    return met.where(over[0] & over[1]).select("doc_id", "page_index", "block_id", F.col("o_block_id").alias("other"))


@query("""
WITH p AS (SELECT o_orderkey, (o_custkey % 50)::INTEGER AS grp, (o_orderkey % 7)::INTEGER AS rot, 6.0::DOUBLE + (o_orderkey * 13 % 32) / 7.0::DOUBLE AS size FROM orders),
t AS (SELECT grp, count(*) AS n, greatest(min(size)::DOUBLE, median(size)::DOUBLE * 0.85::DOUBLE) AS target FROM p WHERE rot <> 0 GROUP BY grp)
SELECT o_orderkey, CASE WHEN rot <> 0 AND n >= 3 AND size > target THEN round(target, 2) ELSE size END::DOUBLE AS size FROM p JOIN t USING (grp)
""")
def harmonize_sizes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).cast("int").alias("grp"), (k % 7).alias("rot"), (6.0 + (k * 13 % 32) / 7.0).alias("font_size"))
    p = p.withColumn("key", F.when(F.col("rot") != 0, F.col("grp")))
    return Y.harmonize(p, []).select("o_orderkey", F.col("harmonized").alias("size"))


@query(f"""
WITH p AS (SELECT doc_id, page_index, line_id, column_index, CASE WHEN {S.like("text", S.T.BULLET)} OR w < 360 THEN 'body' ELSE 'caption' END AS kind_class, 9.0::DOUBLE + (m % 37) / 16.0::DOUBLE AS size, k % 7 = 3 AS rotated FROM ({_COLUMNS})),
t AS (SELECT doc_id, column_index, kind_class, round_even(size, 0) AS r, greatest(min(size)::DOUBLE, median(size)::DOUBLE * 0.85::DOUBLE) AS target FROM p WHERE NOT rotated GROUP BY ALL HAVING count(*) >= 3)
SELECT p.doc_id, p.page_index, p.line_id, CASE WHEN NOT rotated AND size > target THEN round_even(target, 2) ELSE size END::DOUBLE AS size
FROM p LEFT JOIN t ON p.doc_id = t.doc_id AND p.column_index IS NOT DISTINCT FROM t.column_index AND p.kind_class = t.kind_class AND round_even(p.size, 0) = t.r
""")
def harmonize_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a document that share column, kind and rounded size, and are not rotated, with the sizes they shrink to."""
    p = Y.detect_columns(placed(spark, d)).withColumn("font_size", 9.0 + (F.col("m") % 37) / 16.0)
    kind = F.when(T.is_bullet(F.col("text")), "bullet").when(G.is_wide(F.struct("x0", "y0", "x1", "y1"), F.col("page_width")), "caption").otherwise("line")
    p = p.withColumn("key", G.harmonize_key(kind, F.col("column_index"), F.col("font_size"), F.col("k") % 7 == 3))
    return Y.harmonize(p, ["doc_id"]).select("doc_id", "page_index", "line_id", F.col("harmonized").alias("size"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, (l_quantity * 4 + (l_orderkey % 2) * 0.001)::DOUBLE AS x0, (l_quantity % 3)::DOUBLE AS y0, (l_quantity * 4 + 60 + l_quantity)::DOUBLE AS x1, (40 + l_quantity)::DOUBLE AS y1, l_suppkey FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, round_even(x0, 2), round_even(y0, 2), round_even(x1, 2), round_even(y1, 2) ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM r)
SELECT l_orderkey, l_linenumber, x1 - x0 >= 80 AND y1 - y0 >= 50 AS useful, round(x0 + 0.25 * (x1 - x0), 6) AS px0, round(y0 + 0.5 * (y1 - y0), 6) AS py0 FROM f WHERE k = 1
""")
def image_rect_dedupe(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (q * 4 + (F.col("l_orderkey") % 2) * 0.001).alias("x0"), (q % 3).alias("y0"), (q * 4 + 60 + q).alias("x1"), (q + 40).alias("y1"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("no"))
    f = Y.distinct_boxes(r, ["l_suppkey"], "no")
    box = F.struct("x0", "y0", "x1", "y1")
    inner = G.from_thousandths(F.struct(F.lit(250).alias("x0"), F.lit(500).alias("y0"), F.lit(750).alias("x1"), F.lit(900).alias("y1")), box)
    return f.select("l_orderkey", "l_linenumber", G.useful_image(box).alias("useful"), F.round(inner["x0"], 6).alias("px0"), F.round(inner["y0"], 6).alias("py0"))


@query("""
WITH b AS (SELECT p_partkey, list_extract(['abstract', 'caption', 'paragraph', 'line', 'title'], (p_partkey % 5 + 1)::INTEGER) AS kind, (p_size + 4)::DOUBLE AS s, (1 + p_partkey % 4)::INTEGER AS n, (p_partkey % 3)::INTEGER AS col FROM part),
g AS (SELECT *, kind = 'title' OR s >= 36 AS display,
  CASE kind WHEN 'abstract' THEN greatest(2.8, 1.1 + n * 1.1) WHEN 'caption' THEN greatest(1.8, 0.95 + n * 0.95) WHEN 'paragraph' THEN greatest(2.4, 1.15 + n * 1.02) ELSE greatest(1.45, 0.9 + n * 0.7) END::DOUBLE AS f,
  CASE kind WHEN 'abstract' THEN least(20.0, s * 1.1) WHEN 'caption' THEN least(6.0, s * 0.25) WHEN 'paragraph' THEN least(14.0, s * 0.75) ELSE least(10.0, s * 0.5) END::DOUBLE AS e FROM b)
SELECT p_partkey, round(CASE WHEN display THEN 0.0 WHEN col < 2 THEN least(e, 6.0) ELSE e END, 6)::DOUBLE AS extra_width, round(CASE WHEN display THEN 12.0 WHEN col < 2 THEN greatest(12.0, s * f) * 1.18 ELSE greatest(12.0, s * f) END, 6)::DOUBLE AS height,
  CASE WHEN display THEN greatest(8.0, s) WHEN kind = 'caption' THEN greatest(6.0, least(s, 18.0)) ELSE greatest(6.5, least(s, 28.0)) END::DOUBLE AS size,
  CASE WHEN kind = 'title' THEN 1.05 WHEN s >= 36 THEN 1.08 WHEN kind = 'caption' THEN 1.06 WHEN kind IN ('paragraph', 'abstract') THEN 1.18 ELSE 1.12 END::DOUBLE AS line_height FROM g
""")
def box_growth(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, ("abstract", "caption", "paragraph", "line", "title"))), (k % 5).cast("int"))
    b = table(spark, d, "part").select("p_partkey", kind.alias("kind"), (F.col("p_size") + 4).cast("double").alias("s"), (1 + k % 4).alias("n"), F.when(k % 3 < 2, (k % 3).cast("int")).alias("col"))
    b = b.withColumn("g", G.growth(F.col("kind"), F.col("s"), F.col("n"), F.lit(12.0), F.col("col"), F.lit(False))).withColumn("z", G.start_size(F.col("kind"), F.col("s")))
    return b.select("p_partkey", F.round("g.extra_width", 6).alias("extra_width"), F.round("g.height", 6).alias("height"), "z.size", "z.line_height")


def _first_fit(start: str, least: str, heights: str, width: str, room: str, text: str) -> str:
    sizes = f"list_transform(range(0, greatest(ceil(ln({start} / least({start}, {least})) / -ln(0.92::DOUBLE)), 0)::BIGINT + 1), lambda k: {start} * pow(0.92::DOUBLE, k))"
    fits = f"list_filter(flatten(list_transform({heights}, lambda h: list_transform({sizes}, lambda z: {{'z': z, 'h': h}}))), lambda c: c.z >= least({start}, {least}) - 0.01 AND ceil(length({text}) / greatest(floor({width} / (c.z * 0.5::DOUBLE)), 1)) * c.z * c.h <= {room})"
    return f"list_extract({fits}, 1)"


@query(f"""
SELECT doc_id, page_index, line_id, round(f.z, 4) AS fitted_size, f.h AS fitted_line_height FROM (
  SELECT doc_id, page_index, line_id, {_first_fit("s", "6.5::DOUBLE", "[1.18::DOUBLE, 1.0::DOUBLE, 0.94::DOUBLE]", "w", "36.0::DOUBLE", "text")} AS f FROM (SELECT *, greatest(6.5, least(font_size, 28.0))::DOUBLE AS s FROM ({_BOXES})))
""")
def fitted_sizes_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Largest size at which a line's text, by an estimated width, fits a box of three lines' height."""
    p = placed(spark, d).withColumn("start", G.start_size(F.lit("paragraph"), F.col("font_size"))).withColumn("room", F.lit(36.0))
    return Y.fit_size(p).select("doc_id", "page_index", "line_id", F.round("fitted_size", 4).alias("fitted_size"), "fitted_line_height")


def _advance(c: str, bold: str) -> str:
    """SQL: thousandths of an em of a character, by where it is in the lists of characters."""

    def of(table: dict[int, str]) -> str:
        return "CASE " + " ".join(f"WHEN contains({S.lit(chars)}, strip_accents({c})) THEN {width}" for width, chars in table.items()) + " END"

    return f"CASE WHEN unicode({c}) NOT BETWEEN 32 AND 383 THEN 500 WHEN strip_accents({c}) = 'i' AND {c} <> 'i' THEN 278 WHEN {bold} THEN coalesce({of(M.BOLD)}, 500) ELSE coalesce({of(M.REGULAR)}, 500) END"


# Words fold into lines: n lines so far, x used of the last one, f before the first word.
_GLYPH = "CASE WHEN b.x > 0 AND b.x + g.x > room THEN {'n': b.n + 1, 'x': g.x} ELSE {'n': b.n, 'x': b.x + g.x} END"
_BROKEN = f"list_reduce(list_transform(u.g, lambda y: {{'n': 0, 'x': y}}), lambda b, g: {_GLYPH}, {{'n': a.n + CASE WHEN a.f THEN 0 ELSE 1 END, 'x': 0}})"
_WORD = f"""CASE WHEN NOT a.f AND a.x + 278 + u.x <= room THEN {{'n': a.n, 'x': a.x + 278 + u.x, 'f': false, 'g': u.g}}
  WHEN u.x <= room THEN {{'n': a.n + CASE WHEN a.f THEN 0 ELSE 1 END, 'x': u.x, 'f': false, 'g': u.g}}
  ELSE {{'n': ({_BROKEN}).n, 'x': ({_BROKEN}).x, 'f': false, 'g': u.g}} END"""


@query(f"""
WITH b AS (SELECT doc_id, page_index, line_id, w, m % 3 = 0 AS bold, text, greatest(6.5, least(font_size, 28.0))::DOUBLE AS s FROM ({_BOXES})),
c AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS c FROM b),
v AS (SELECT map(list(c), list({_advance("c", "false")})) AS regular, map(list(c), list({_advance("c", "true")})) AS bold_ FROM c),
g AS (SELECT b.*, list_transform(string_split(text, ' '), lambda t: list_transform(regexp_extract_all(t, '(?s).'), lambda c: CASE WHEN bold THEN bold_[c] ELSE regular[c] END::INTEGER)) AS glyphs FROM b, v),
p AS (SELECT *, list_transform(glyphs, lambda t: {{'n': 0, 'x': coalesce(list_sum(t), 0)::INTEGER, 'f': false, 'g': t}}) AS words FROM g),
z AS (SELECT *, k, s * pow(0.92::DOUBLE, k) AS size FROM (SELECT *, unnest(range(0, ceil(ln(s / 6.5::DOUBLE) / -ln(0.92::DOUBLE))::BIGINT + 1)) AS k FROM p)),
n AS (SELECT doc_id, page_index, line_id, k, size, (list_reduce(words, lambda a, u: {_WORD}, {{'n': 1, 'x': 0, 'f': true, 'g': []::INTEGER[]}})).n AS lines
  FROM (SELECT *, floor(w * 1000 / size) AS room FROM z WHERE size >= 6.5 - 0.01)),
f AS (SELECT doc_id, page_index, line_id, arg_min({{'z': size, 'h': h, 'n': lines}}, i * 1000 + k) FILTER (lines * size * h <= 36.0::DOUBLE) AS f
  FROM (SELECT *, [1.18::DOUBLE, 1.0::DOUBLE, 0.94::DOUBLE][i] AS h FROM (SELECT *, unnest([1, 2, 3]) AS i FROM n)) GROUP BY ALL)
SELECT doc_id, page_index, line_id, round(f.z, 4) AS fitted_size, f.h AS fitted_line_height, f.n::INTEGER AS fitted_lines FROM f
""")
def fitted_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Largest size at which a line's words, by the advances of its font, fit a box of three lines' height."""
    font = T.base_font(F.when(F.col("m") % 3 == 0, "Text-Bold").otherwise("Text-Roman"))
    p = placed(spark, d).withColumn("font", font).withColumn("start", G.start_size(F.lit("paragraph"), F.col("font_size"))).withColumn("room", F.lit(36.0))
    return Y.fit_size(p, advances=M.base_advances(spark)).select("doc_id", "page_index", "line_id", F.round("fitted_size", 4).alias("fitted_size"), "fitted_line_height", "fitted_lines")


@query(f"""
WITH t AS (SELECT doc_id, page_index, line_id, text, x0 - 1.5 AS x0, y0 - 1.5 AS y0, CASE WHEN w + 3 < 12 OR h + 3 < 8 THEN greatest(24.0, w + 3) ELSE w + 3 END::DOUBLE AS w, CASE WHEN w + 3 < 12 OR h + 3 < 8 THEN greatest(12.0, h + 3) ELSE h + 3 END::DOUBLE AS h
  FROM (SELECT doc_id, page_index, line_id, text, x0, y0, CASE WHEN m % 4 = 0 THEN (m % 16)::DOUBLE ELSE w END AS w, (m % 60)::DOUBLE AS h FROM ({_BOXES})))
SELECT doc_id, page_index, line_id, x0, y0, w, h, round(f.z, 4) AS overlay_size FROM (SELECT *, {_first_fit("s", "6.0::DOUBLE", "[1.08::DOUBLE]", "w", "h", "text")} AS f FROM (SELECT *, greatest(7.5, least(18.0, h * 0.72))::DOUBLE AS s FROM t))
""")
def overlay_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes at which lines fit boxes of many heights, as over text in images."""
    m = F.col("m")
    p = placed(spark, d).withColumn("x1", F.col("x0") + F.when(m % 4 == 0, (m % 16).cast("double")).otherwise(F.col("w"))).withColumn("y1", F.col("y0") + (m % 60).cast("double"))
    o = Y.fit_overlay(p)
    return o.select("doc_id", "page_index", "line_id", "target.x0", "target.y0", G.width(F.col("target")).alias("w"), G.height(F.col("target")).alias("h"), F.round("overlay_size", 4).alias("overlay_size"))


@query("""
SELECT event_id, round(CASE WHEN now > room + 1 THEN greatest(0.85, room / now) ELSE 1.0 END, 6)::DOUBLE AS squeeze, size, now * 0.85 > room + 1 AS clipped FROM (
  SELECT *, w * size / 20.0 AS now FROM (SELECT *, 20.0 - least(ceil((20.0 - 14.4) / 0.25), greatest(ceil((20.0 - (room + 1) * 20.0 / w) / 0.25), 0)) * 0.25 AS size FROM (SELECT event_id, (100 + event_id % 200)::DOUBLE AS w, 120.0::DOUBLE AS room FROM events)))
""")
def overflow_fit(spark: SparkSession, d: str) -> DataFrame:
    w = (100 + F.col("event_id") % 200).cast("double")
    f = table(spark, d, "events").select("event_id", G.overflow_fit(w, F.lit(120.0), F.lit(20.0)).alias("f"))
    return f.select("event_id", F.round("f.squeeze", 6).alias("squeeze"), "f.size", "f.clipped")


@query("""
SELECT DISTINCT l_suppkey, round_even(l_quantity * 1.5, 2) AS x0, l_linenumber AS kind, l_partkey AS target FROM lineitem l WHERE l_orderkey % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM lineitem h WHERE h.l_orderkey % 2 = 1 AND h.l_suppkey = l.l_suppkey AND round_even(h.l_quantity * 1.5, 2) = round_even(l.l_quantity * 1.5, 2) AND h.l_linenumber = l.l_linenumber AND h.l_partkey = l.l_partkey)
""")
def links_missing(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("doc_id"), F.lit(0).alias("page_index"), (F.col("l_quantity") * 1.5).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"), F.col("l_linenumber").alias("kind"), F.lit(None).cast("string").alias("uri"), F.col("l_partkey").alias("target"))
    return Y.missing_links(l.where("l_orderkey % 2 = 0"), l.where("l_orderkey % 2 = 1")).select(F.col("doc_id").alias("l_suppkey"), "x0", "kind", "target")


@query(f"SELECT doc_id, page_index, line_id, {S.native_text('text')} AS ok, x0, y0 FROM ({_BOXES}) WHERE NOT {S.native_text('text')}")
def untranslatable_lines(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d).where(~P.native_text(F.col("text"))).select("doc_id", "page_index", "line_id", P.native_text(F.col("text")).alias("ok"), "x0", "y0")


@query("""
SELECT event_id, greatest(0.0, x - 2) AS "left", greatest(0.0, y - 2) AS top, round(greatest(36.0, w * 1.18), 6)::DOUBLE AS width, round(greatest(18.0, h * 1.35), 6)::DOUBLE AS height, round(greatest(10.0, least(24.0, h * 0.72)), 6)::DOUBLE AS font_size
FROM (SELECT event_id, (event_id % 100)::DOUBLE AS x, (event_id % 7)::DOUBLE AS y, (event_id % 90)::DOUBLE AS w, (event_id % 40)::DOUBLE AS h FROM events)
""")
def overlay_geometry(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    b = table(spark, d, "events").select("event_id", F.struct((k % 100).cast("double").alias("x0"), (k % 7).cast("double").alias("y0"), (k % 100 + k % 90).cast("double").alias("x1"), (k % 7 + k % 40).cast("double").alias("y1")).alias("b"))
    o = b.select("event_id", G.overlay(F.col("b")).alias("o"))
    return o.select("event_id", "o.left", "o.top", *[F.round(f"o.{n}", 6).alias(n) for n in ("width", "height", "font_size")])


_RANGES = [("latin", 1, 0, 255), ("wide", 2, 0, 0x24F), ("symbols", 3, 0x2000, 0x2BFF)]


@query("""
SELECT doc_id, CASE WHEN NOT regexp_matches(t, '[^\\x{0}-\\x{ff}]') THEN 'latin' WHEN NOT regexp_matches(t, '[^\\x{0}-\\x{24f}]') THEN 'wide' ELSE 'latin' END AS font FROM (SELECT doc_id, text || list_extract(['', 'ł', '→', 'ж'], (doc_id % 4 + 1)::INTEGER) AS t FROM documents)
""")
def font_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.concat("text", F.get(F.array(*map(F.lit, ("", "ł", "→", "ж"))), (F.col("doc_id") % 4).cast("int"))).alias("text"))
    return Y.covering_font(t, spark.createDataFrame(_RANGES, "font string, priority int, first long, last long"), "doc_id")


@query(f"""
SELECT conv_id, sha256(arg_max(text, (length({S.strip("text")}), size, -turn))) AS text, arg_max(size, (length({S.strip("text")}), size, -turn)) AS size, max(size) AS largest
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '  ' || text || ' ' ELSE text END AS text, (9 + (conv_id + turn) % 4)::DOUBLE AS size FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn + 100, text FROM conversations)) GROUP BY conv_id
""")
def style_spans(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a conversation, each twice, as the spans of a block."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    c = c.union(c.withColumn("turn", F.col("turn") + 100)).withColumn("text", F.when(F.col("turn") % 3 == 1, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise(F.col("text")))
    spans = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", (9.0 + (F.col("conv_id") + F.col("turn")) % 4).alias("size")))).alias("s"))
    span = Y.style_span(F.col("s"))
    return spans.select("conv_id", F.sha2(span["text"], 256).alias("text"), span["size"].alias("size"), F.array_max(F.transform("s", lambda x: x["size"])).alias("largest"))


@query("""
SELECT l_orderkey, l_linenumber AS page_no, l_quantity * 12.5 AS width, (l_linenumber * 100 + l_suppkey % 7)::DOUBLE AS height FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey % 5 <> 0
""")
def image_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of converted files that have a size and a background image: one file an order, one div a line of it."""
    from ..sources import html

    size = F.format_string("position:relative;width:%spx;%s", (F.col("l_quantity") * 12.5).cast("string"), F.when(F.col("l_suppkey") % 5 != 0, F.format_string("height:%dpx;", F.col("l_linenumber") * 100 + F.col("l_suppkey") % 7)).otherwise(""))
    div = F.format_string('<div id="page%d-div" style="%s">%s</div>', F.col("l_linenumber"), size, F.when(F.col("l_returnflag") == "R", "text <b>only</b>").otherwise('\n<img src="b.png"/>'))
    pages = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", div.alias("div")))), lambda x: x["div"]), "\n").alias("html"))
    return html.image_pages(pages, "l_orderkey")


_SIDES = "SELECT l_orderkey, l_linenumber, (l_partkey * 7919 + l_suppkey)::BIGINT % 16777216 AS packed, (l_partkey % 401 - 200) / 200.0::DOUBLE AS dx, (l_suppkey % 41 - 20) / 20.0::DOUBLE AS dy, l_quantity AS w, l_linenumber * 0.75::DOUBLE AS h FROM lineitem"


@query(f"""
SELECT l_orderkey, l_linenumber, round((packed >> 16) / 255.0::DOUBLE, 9) AS r, round(((packed >> 8) & 255) / 255.0::DOUBLE, 9) AS g, round((packed & 255) / 255.0::DOUBLE, 9) AS b,
  CASE WHEN dx <= -0.92 THEN 180 WHEN dy <= -0.92 THEN 90 WHEN dy >= 0.92 THEN 270 ELSE 0 END::INTEGER AS rotation, round(w / 72, 9) AS inches, round(least(300 / w, 100 / h), 9) AS scale,
  h >= 1 AND w >= 1 AS usable, w < 3 OR h < 3 AS degenerate FROM ({_SIDES})
""")
def box_forms(spark: SparkSession, d: str) -> DataFrame:
    packed = (F.col("l_partkey") * 7919 + F.col("l_suppkey")) % 16777216
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", packed.cast("int").alias("packed"), ((F.col("l_partkey") % 401 - 200) / 200.0).alias("dx"), ((F.col("l_suppkey") % 41 - 20) / 20.0).alias("dy"), F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 0.75).alias("h"))
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("w").alias("x1"), F.col("h").alias("y1"))
    color = G.rgb(F.col("packed"))
    return s.select(
        "l_orderkey", "l_linenumber", *[F.round(color[k], 9).alias(k) for k in "rgb"], G.rotation(F.col("dx"), F.col("dy")).alias("rotation"), F.round(G.inches(F.col("w")), 9).alias("inches"),
        F.round(G.page_scale(F.col("w"), F.col("h"), F.lit(300.0), F.lit(100.0)), 9).alias("scale"), G.usable(box).alias("usable"), ((G.width(box) < 3) | (G.height(box) < 3)).alias("degenerate"),
    )


@query(f"""
WITH RECURSIVE b AS (SELECT doc_id, page_index, line_id, x0 + (m % 3) * 0.25 - w * 0.0 AS x0, y0 - (k % 3) * 12.5 AS y0 FROM ({_BOXES})),
r(doc_id, page_index, line_id, kept) AS (
  SELECT doc_id, page_index, 0, [{{'x': x0, 'y': y0}}] FROM b WHERE line_id = 0
  UNION ALL SELECT r.doc_id, r.page_index, r.line_id + 1, CASE WHEN len(list_filter(r.kept, lambda q: abs(q.x - b.x0) <= 0.5 AND abs(q.y - b.y0) <= 0.5)) > 0 THEN r.kept ELSE list_append(r.kept, {{'x': b.x0, 'y': b.y0}}) END
  FROM r JOIN b ON b.doc_id = r.doc_id AND b.page_index = r.page_index AND b.line_id = r.line_id + 1)
SELECT doc_id, page_index, max(len(kept))::INTEGER AS kept FROM r GROUP BY doc_id, page_index
""")
def tolerant_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page, many of them nearly the same, in order; those kept."""
    m = F.col("m")
    b = placed(spark, d).withColumn("x0", F.col("x0") + (m % 3) * 0.25).withColumn("y0", F.col("y0") - (F.col("k") % 3) * 12.5)
    box = F.struct("line_id", "x0", "y0", F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    pages = b.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return pages.select("doc_id", "page_index", F.size(Y.apart_boxes(F.col("boxes"))).alias("kept"))


@query(f"SELECT doc_id, page_index, line_id FROM ({_BOXES}) WHERE (doc_id + raw_block_id) % 3 = 0")
def raw_block_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines of raw blocks of text; others are images."""
    lines = placed(spark, d)
    raw = lines.select("doc_id", "page_index", "raw_block_id").distinct().withColumn("block_type", ((F.col("doc_id") + F.col("raw_block_id")) % 3).cast("int"))
    return Y.lines_of_text(lines, raw).select("doc_id", "page_index", "line_id")
