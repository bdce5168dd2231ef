"""Page layout: columns, reading order, row stitching, merging of lines to blocks, clearances between boxes, shared sizes.

Lines are rows of schema.LINE. Frame functions are windows over a page; where the next step depends on what was merged so far, a
page's lines (a bounded list) are folded in order with aggregate(), inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import predicates as P
from ..functions import text as T
from ..functions import widths as M
from ..schema import TEXT_BLOCK
from . import boxes as B
from . import ranks as R

PAGE = ["doc_id", "page_index"]


def _box() -> Column:
    return F.struct("x0", "y0", "x1", "y1")


def lines_of_text(lines: DataFrame, raw_blocks: DataFrame) -> DataFrame:
    """The lines whose raw block (schema.RAW_BLOCK) is one of text."""
    keys = [*PAGE, "raw_block_id"]
    return lines.join(raw_blocks.where(F.col("block_type") == TEXT_BLOCK).select(*keys), keys, "left_semi")


def row_order() -> list[Column]:
    return [F.bround("y0", 1), F.bround("x0", 1), F.col("line_id")]


def detect_columns(lines: DataFrame) -> DataFrame:
    """Adds multi_column (the page has two columns) and column_index (0, 1, or null for wide and header lines)."""
    page = Window.partitionBy(*PAGE)
    wide, center, middle = G.is_wide(_box(), F.col("page_width")), (F.col("x0") + F.col("x1")) / 2, F.col("page_width") / 2
    count = lambda c: F.count_if(c).over(page)
    narrow = F.when(~wide, F.col("x1") - F.col("x0"))
    multi = (F.count("*").over(page) >= 16) & (count(~wide) >= 12) & (count(~wide & (center < middle)) >= 5) & (count(~wide & (center >= middle)) >= 5) & (F.avg(narrow).over(page) <= F.col("page_width") * 0.42)
    out = lines.withColumn("multi_column", F.coalesce(multi, F.lit(False)))
    whole = ~F.col("multi_column") | wide | G.in_header_band(_box(), F.col("page_width"))
    return out.withColumn("column_index", F.when(~whole, F.when(center < middle, 0).otherwise(1)))


def reading_order(lines: DataFrame) -> DataFrame:
    """Adds order_no within the page to lines with columns: across columns, full width first, left, right, then what is between or below."""
    page = Window.partitionBy(*PAGE)
    inside = F.col("column_index").isNotNull()
    top, bottom = F.min(F.when(inside, F.col("y0"))).over(page), F.max(F.when(inside, F.col("y1"))).over(page)
    zone = F.when(~F.col("multi_column") | top.isNull(), 0).when(F.col("column_index") == 0, 1).when(F.col("column_index") == 1, 2).when(F.col("y0") < top - 6, 0).when(F.col("y0") > bottom + 6, 4).otherwise(3)
    out = lines.withColumn("zone", zone)
    return out.withColumn("order_no", F.row_number().over(page.orderBy("zone", *row_order())) - 1)


def stitchable_rows(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fragments, stitchable): whether a row's fragments (x0, x1, size, r, g, b) read as one line, left to right."""
    after = Window.partitionBy(*keys).orderBy("x0", "frag_no")
    nxt = {k: F.lead(k).over(after) for k in ("x0", "size", "r", "g", "b")}
    f = fragments.select(*keys, "frag_no", "x0", "x1", "size", "r", "g", "b", *[v.alias(f"next_{k}") for k, v in nxt.items()])
    gap = F.col("next_x0") - F.col("x1")
    larger = F.greatest("size", "next_size")
    color = F.greatest(*[F.abs(F.col(k) - F.col(f"next_{k}")) for k in ("r", "g", "b")])
    apart = (gap < -1) | (gap > 3 * F.greatest(larger, F.lit(1.0))) | (F.abs(F.col("size") - F.col("next_size")) > 0.25 * larger) | (color > 0.20)
    return f.groupBy(*keys).agg(F.count("*").alias("fragments"), F.bool_and(F.col("next_x0").isNull() | ~apart).alias("stitchable"))


def style_span(spans: Column) -> Column:
    """The span with the longest stripped text, of these the largest, of these the first."""
    scored = F.transform(spans, lambda s, i: F.struct(F.length(T.strip(F.coalesce(s["text"], F.lit("")))).alias("n"), F.coalesce(s["size"], F.lit(0.0)).alias("size"), (-i).alias("first"), s.alias("span")))
    return F.array_max(F.transform(scored, lambda s: F.struct(s["n"].alias("n"), s["size"].alias("size"), s["first"].alias("first"), s["span"].alias("span"))))["span"]


def _rows_of(boxes: list, least: float) -> list[int]:
    """Heads of rows lie in all bands of the page that they touch, so that a box looks at those near it only."""
    size = max(1.0, sum(b["y1"] - b["y0"] for b in boxes) / max(len(boxes), 1))
    bands: dict[int, list[int]] = {}
    heads, rows = [], []
    for b in boxes:
        y0, y1 = b["y0"], b["y1"]
        near = range(int(y0 // size), int(max(y0, y1) // size) + 1)
        fits = [k for band in near for k in bands.get(band, ()) if (shared := min(heads[k][1], y1) - max(heads[k][0], y0)) > 0 and shared / min(heads[k][1] - heads[k][0], y1 - y0) >= least]
        rows.append(min(fits, default=len(heads)))
        if not fits:
            for band in near:
                bands.setdefault(band, []).append(len(heads))
            heads.append((y0, y1))
    return rows


def cluster_rows(boxes: Column, least: float = 0.6) -> Column:
    """array<int>: the row of each box in order; a box joins the first row whose first box it overlaps enough in height."""

    @F.pandas_udf("array<int>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda boxes: None if boxes is None else _rows_of(list(boxes), least))

    return run(F.transform(boxes, lambda b: F.struct(b["y0"].alias("y0"), b["y1"].alias("y1"))))


def mergeable(p: Column, c: Column) -> Column:
    """Whether line c continues what was merged so far, p. Structs with the fields of a line, multi_column and column_index."""
    size = p["font_size"]
    gap = c["y0"] - p["y1"]
    shared = G.overlap(p["x0"], p["x1"], c["x0"], c["x1"])
    alike = (p["rotation"] == 0) & (c["rotation"] == 0) & p["font_name"].eqNullSafe(c["font_name"]) & p["raw_block_id"].eqNullSafe(c["raw_block_id"]) & ~G.colors_apart(p, c)
    near = (F.abs(size - c["font_size"]) <= F.greatest(F.lit(0.75), size * 0.08)) & gap.between(-F.greatest(F.lit(2.0), size * 0.55), F.greatest(size * 0.7, F.lit(4.0)))
    aligned = (F.abs(c["x0"] - p["x0"]) <= F.greatest(size * 1.5, F.lit(18.0))) & (G.width(p) > 0) & (G.width(c) > 0) & (shared >= F.least(G.width(p), G.width(c)) * 0.35)
    plain = c["plain"] & ~c["starts"] & p["plain"] & ~p["text"].rlike(f":{T.SPACE}*$")
    apart = (gap > F.greatest(F.lit(1.5), size * 0.18)) & P.sentence_boundary(p["text"], c["text"])
    column = ~p["multi_column"] | p["column_index"].eqNullSafe(c["column_index"])
    return F.coalesce(alike & near & aligned & column, F.lit(False)) & plain & ~apart


_FIELDS = ["x0", "y0", "x1", "y1", "text", "font_name", "font_size", "r", "g", "b", "raw_block_id", "rotation", "confidence", "page_width", "multi_column", "column_index", "line_count", "boxes", "plain", "starts"]


def _plain(text: Column) -> Column:
    """No table row, reference or page header: such lines stay by themselves."""
    return T.let(T.collapse(text), lambda s: ~P.table_row(s) & ~P.flat_reference_line(s) & ~P.flat_header_or_footer(s))


def _merged(p: Column, c: Column) -> Column:
    """p grown by c."""
    new = {k: p[k] for k in _FIELDS}
    for k, op in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest), ("confidence", F.least)):
        new[k] = op(p[k], c[k])
    new |= {"line_count": p["line_count"] + c["line_count"], "boxes": F.concat(p["boxes"], c["boxes"])}
    made = lambda text: F.struct(*[(text if k == "text" else _plain(text) if k == "plain" else new[k]).alias(k) for k in _FIELDS])
    return T.let(T.join_hyphened(p["text"], c["text"]), made)


def _folded(items: Column, joins) -> Column:
    """Items in order, each merged into the last one of the result where joins(last, item)."""

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        go_on = F.when(F.size(acc) > 0, joins(last, c)).otherwise(F.lit(False))
        return F.when(go_on, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(_merged(last, c)))).otherwise(F.concat(acc, F.array(c)))

    return T.let(items, lambda a: F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1), step))


def continues_word(p: Column, c: Column) -> Column:
    """Whether block c goes on with a word that block p breaks off by a hyphen."""
    gap, size = c["y0"] - p["y1"], p["font_size"]
    return P.word_hyphen_end(p["text"]) & p["column_index"].eqNullSafe(c["column_index"]) & (p["rotation"] == 0) & (c["rotation"] == 0) & T.lstrip(c["text"]).rlike(r"^\p{Ll}") & gap.between(-F.greatest(F.lit(2.0), size * 0.55), F.greatest(size * 0.7, F.lit(4.0)))


def block_kind(text: Column, line_count: Column, page_top: Column, font_size: Column, page_width: Column, block_width: Column) -> Column:
    title = (block_width >= page_width * 0.45) & (((page_top < 120) & (font_size >= 14)) | ((page_top < F.greatest(F.lit(120.0), page_width * 0.18)) & (font_size >= 36)))

    def of(x: Column) -> Column:
        text, s, n = x["text"], x["flat"], x["n"]
        generic = F.when(T.is_bullet(text), "bullet").when(F.endswith(T.strip(text), F.lit(":")) & (n == 1), "label").when(n > 1, "paragraph").otherwise("line")
        head = F.lower(F.left(s, F.lit(10)))
        starts = lambda *w: F.greatest(*[F.startswith(head, F.lit(v)) for v in (*w, w[0])])
        named = F.when(starts("abstract"), "abstract").when(starts("keyword"), "keywords").when(starts("references"), "reference").when(starts("fig.", "figure ", "table "), "caption").when(x["title"], "title").when(n > 1, "paragraph")
        return F.when(s == "", generic).when(P.table_row(s), "table").otherwise(F.coalesce(named, generic))

    return T.let(F.struct(text.alias("text"), T.collapse(text).alias("flat"), line_count.alias("n"), title.alias("title")), of)


def alignment(boxes: Column, text: Column, kind: Column | None = None) -> Column:
    """left, center or right, from the edges of a block's lines."""
    spread = lambda a: F.array_max(a) - F.array_min(a)
    lefts, rights, centers = (F.transform(boxes, f) for f in (lambda b: b["x0"], lambda b: b["x1"], lambda b: (b["x0"] + b["x1"]) / 2))
    n, left, right, center = F.size(boxes), spread(lefts), spread(rights), spread(centers)
    inner = F.slice(F.array_sort(lefts), 2, F.greatest(n - 1, F.lit(0)))
    out = (
        F.when(n < 2, "left")
        .when((left > 6) & (center <= F.greatest(F.lit(3.0), left * 0.25)), "center")
        .when((n >= 3) & (right <= 2.5) & (left > 6) & (center > right) & ~T.is_bullet(text) & (spread(inner) > 4), "right")
        .otherwise("left")
    )
    return out if kind is None else F.when((kind == "caption") & (n == 1), "center").otherwise(out)


def blocks(lines: DataFrame, hyphens: bool = True) -> DataFrame:
    """Merge ordered lines (schema.LINE with columns and order_no) to blocks.

    (doc_id, page_index, block_no, x0, y0, x1, y1, text, font_size, column_index, rotation, confidence, line_count, kind, alignment):
    each line is tried against what was merged so far; then blocks that break off in the middle of a word take the next one.
    """
    box = F.array(F.struct("x0", "y0", "x1", "y1"))
    # What does not depend on merging is worked out once a line, before the fold. A tab shows a table row, but not at a bullet.
    plain = _plain(F.col("text")) & ~P.table_row(F.col("text"))
    item = F.struct("order_no", *[F.col(k) for k in _FIELDS[:-4]], F.lit(1).alias("line_count"), box.alias("boxes"), plain.alias("plain"), P.starts_structure(F.col("text")).alias("starts"))
    page = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("items"))
    items = F.transform("items", lambda x: F.struct(*[x[k].alias(k) for k in _FIELDS]))
    page = page.select(*PAGE, _folded(items, mergeable).alias("items"))
    if hyphens:
        page = page.select(*PAGE, _folded(F.col("items"), continues_word).alias("items"))
    # No page is without an item; from an explode that is not outer the optimizer makes a filter, which folds all pages once more.
    each = page.select(*PAGE, F.posexplode_outer("items").alias("block_no", "b")).select(*PAGE, "block_no", "b.*")
    kind = block_kind(F.col("text"), F.col("line_count"), F.col("y0"), F.col("font_size"), F.col("page_width"), F.col("x1") - F.col("x0"))
    each = each.withColumn("kind", kind)
    return each.withColumn("alignment", alignment(F.col("boxes"), F.col("text"), F.col("kind"))).drop("boxes", "multi_column", "plain", "starts")


def mark_references(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds is_reference: from the first references heading in a document's second half on."""
    doc = Window.partitionBy("doc_id")
    out = rows.withColumn("__no", F.row_number().over(doc.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(doc))
    heading = P.reference_heading(F.col("text")) & (F.col("__no") >= F.floor(F.col("__n") / 2))
    first = F.min(F.when(heading, F.col("__no"))).over(doc)
    return out.withColumn("is_reference", F.coalesce(F.col("__no") >= first, F.lit(False))).drop("__no", "__n")


def _edges() -> tuple[Column, Column]:
    """The boxes of a block and an obstacle that nearest() brings together."""
    return _box(), F.struct(*[F.col(f"o_{k}").alias(k) for k in ("x0", "y0", "x1", "y1")])


def room_below(blocks_: DataFrame, obstacles: DataFrame, page_bottom: float = 842.0) -> DataFrame:
    """(doc_id, page_index, block_id, vertical_limit): how far down a block may grow before the nearest obstacle below it."""
    b, ob = _edges()
    since = F.col("y0") + F.greatest(F.lit(4.0), F.col("font_size") * 0.6)
    blocks_ = blocks_.select(*PAGE, "block_id", "x0", "y0", "x1", "y1", since.alias("since"), F.col("x0").alias("side0"), F.col("x1").alias("side1"))
    o = obstacles.select(*PAGE, "x0", "y0", "x1", "y1", F.col("y0").alias("at"), F.col("x0").alias("side0"), F.col("x1").alias("side1"))
    meets = (F.col("o_y0") > F.col("since")) & (G.overlap(F.col("x0"), F.col("x1"), F.col("o_x0"), F.col("o_x1")) > F.least(G.width(b), G.width(ob)) * 0.30) & ~G.same(b, ob)
    ids, least = ["block_id", "y0"], {"near": F.when(F.col("o_at") >= F.col("since"), F.col("o_at"))}
    near = B.by_crowd(blocks_, o, PAGE, lambda own, others: B.compared(own, others, PAGE, ids, meets, least), lambda own, others: B.nearest(own, others, PAGE, ids, meets))
    return near.select(*PAGE, "block_id", F.greatest(F.col("y0") + 10, F.least(F.lit(page_bottom - 2), F.coalesce(F.col("near") - 1, F.lit(page_bottom)))).alias("vertical_limit"))


def room_beside(blocks_: DataFrame, obstacles: DataFrame, page_width: float = 600.0, margin: float = 2.0, gap: float = 2.0) -> DataFrame:
    """(doc_id, page_index, block_id, left_limit, right_limit): free room in a block's rows."""
    b, ob = _edges()
    meets = (G.overlap(F.col("y0"), F.col("y1"), F.col("o_y0"), F.col("o_y1")) > 0.5) & ~G.same(b, ob)
    box = [*PAGE, "x0", "y0", "x1", "y1", F.col("y0").alias("side0"), F.col("y1").alias("side1")]
    keys, after = [*PAGE, "block_id"], F.col("o_x1") > F.col("x0")

    def few(own: DataFrame, others: DataFrame) -> DataFrame:
        least = {"near": F.when(after & (F.col("o_x0") >= F.col("x1")), F.col("o_x0")), "__left": F.when(F.col("o_x1") <= F.col("x0"), -F.col("o_x1"))}
        return B.compared(own, others, PAGE, ["block_id"], meets, least)

    def many(own: DataFrame, others: DataFrame) -> DataFrame:
        right = B.nearest(own.withColumn("since", F.col("x1")), others.withColumn("at", F.col("x0")), PAGE, ["block_id"], meets & after)
        left = B.nearest(own.withColumn("since", -F.col("x0")), others.withColumn("at", -F.col("x1")), PAGE, ["block_id"], meets)
        return R.group_join(left.withColumnRenamed("near", "__left"), right, keys)

    both = B.by_crowd(blocks_.select("block_id", *box), obstacles.select(*box), PAGE, few, many)
    return both.select(*keys, F.greatest(F.lit(margin), F.coalesce(-F.col("__left") + gap, F.lit(margin))).alias("left_limit"), F.least(F.lit(page_width - margin), F.coalesce(F.col("near") - gap, F.lit(page_width))).alias("right_limit"))


def trimmed(box: Column, avoid: Column) -> Column:
    """box cut back from each of the boxes to avoid, in order, each cut judged on what is left."""
    gap = 0.25

    def step(r: Column, a: Column) -> Column:
        across, down = G.overlap(r["x0"], r["x1"], a["x0"], a["x1"]), G.overlap(r["y0"], r["y1"], a["y0"], a["y1"])
        hit = (across > 0) & (down > 0)
        stacked = across / F.greatest(F.lit(1.0), F.least(G.width(r), G.width(a))) >= 0.25
        side = down / F.greatest(F.lit(1.0), F.least(G.height(r), G.height(a))) >= 0.25
        within = lambda v, k: (r[f"{k}0"] < v) & (v < r[f"{k}1"])
        y1 = F.when(hit & stacked & within(a["y0"], "y"), F.least(r["y1"], a["y0"] - gap)).otherwise(r["y1"])
        y0 = F.when(hit & stacked & ~within(a["y0"], "y") & within(a["y1"], "y"), F.greatest(r["y0"], a["y1"] + gap)).otherwise(r["y0"])
        x1 = F.when(hit & ~stacked & side & within(a["x0"], "x"), F.least(r["x1"], a["x0"] - gap)).otherwise(r["x1"])
        x0 = F.when(hit & ~stacked & side & ~within(a["x0"], "x") & within(a["x1"], "x"), F.greatest(r["x0"], a["x1"] + gap)).otherwise(r["x0"])
        return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    return F.aggregate(avoid, box, step)


def trim_redactions(blocks_: DataFrame, preserved: DataFrame) -> DataFrame:
    """(doc_id, page_index, block_id, x0, y0, x1, y1, usable) of blocks cut back from the page's preserved boxes, in their order.

    A block only shrinks, so boxes that it does not touch at first never count: each block gets those that it meets.
    """
    met = B.meeting(blocks_.select(*PAGE, "block_id", "x0", "y0", "x1", "y1"), preserved.select(*PAGE, "block_id", "x0", "y0", "x1", "y1"), PAGE)
    o = met.groupBy(*PAGE, "block_id").agg(F.array_sort(F.collect_list(F.struct(F.col("o_block_id").cast("int").alias("block_id"), *[F.col(f"o_{k}").alias(k) for k in ("x0", "y0", "x1", "y1")]))).alias("avoid"))
    met = blocks_.join(o, [*PAGE, "block_id"], "left").withColumn("r", trimmed(_box(), F.coalesce("avoid", F.array().cast("array<struct<block_id:int,x0:double,y0:double,x1:double,y1:double>>"))))
    return met.select(*PAGE, "block_id", "r.*", G.usable(F.col("r")).alias("usable"))


def harmonize(plans: DataFrame, by: list[str], key: str = "key", size: str = "font_size", least: int = 3, floor: float = 0.85) -> DataFrame:
    """Adds harmonized: blocks that share a key shrink to their smallest size, or to 85 % of their median size if that is more.

    Medians are exact for groups of any size; a null key shares nothing.
    """
    keys = [*by, key]
    shared = R.medians(plans.where(F.col(key).isNotNull()), keys, size)
    target = F.greatest(F.col("least"), F.col("median") * floor)
    shared = shared.where(F.col("n") >= least).select(*keys, target.alias("__target"))
    joined = R.group_join(plans, shared, keys, "left")
    return joined.withColumn("harmonized", F.when(F.col(size) > F.col("__target"), F.bround("__target", 2)).otherwise(F.col(size))).drop("__target")


#: Ems that a character takes where there is no font renderer to ask.
CHAR_WIDTH = 0.5


def characters(text: Column, width: Column) -> Callable[[Column], Column]:
    """Lines of a text at a size, at CHAR_WIDTH ems a character and broken into lines of whole characters: an estimate."""
    return lambda size: F.ceil(F.length(text) / F.greatest(F.floor(width / (size * CHAR_WIDTH)), F.lit(1)))


def first_fit(start: Column, least: float, heights: list[Column], room: Column, lines: Callable[[Column], Column], shrink: float = 0.92, at_least: Callable[[Column], Column] | None = None) -> Column:
    """struct<size, line_height, lines>: the first that fits of sizes that go down by 8 % from start, for each line height in turn.

    lines(size) says how many lines the text takes; at_least(size), never more than that, spares the count where even so many do not
    fit. Null where nothing of least or more fits.
    """
    floor_ = F.least(start, F.lit(least))
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log(start / floor_) / -F.log(F.lit(shrink))).cast("int"), F.lit(0)))
    sizes = F.filter(F.transform(steps, lambda k: start * F.pow(F.lit(shrink), k)), lambda s: s >= floor_ - 0.01)
    tried = F.flatten(F.transform(F.array(*heights), lambda h: F.transform(sizes, lambda s: F.struct(s.alias("size"), h.alias("line_height"), F.lit(None).cast("long").alias("lines")))))
    counted = lambda c: T.let(lines(c["size"]).cast("long"), lambda n: F.when(n * c["size"] * c["line_height"] <= room, c.withField("lines", n)))
    hopeless = lambda c: F.lit(False) if at_least is None else F.coalesce(at_least(c["size"]) * c["size"] * c["line_height"] > room, F.lit(False))
    tried_one = lambda best, c: F.when(best.isNotNull(), best).when(~hopeless(c), counted(c))
    return F.aggregate(tried, F.lit(None).cast("struct<size:double,line_height:double,lines:bigint>"), tried_one)


def fit_size(plans: DataFrame, least: float = 6.5, advances: DataFrame | None = None) -> DataFrame:
    """Adds fitted_size, fitted_line_height and fitted_lines to plans (start struct<size, line_height>, x0, x1, room, text), null where nothing fits.

    With advances (font, code, advance in thousandths of an em) lines break between words by the widths of the plans' font
    (functions.widths); without them they are estimated.
    """
    heights = [F.least(F.col("start.line_height"), F.lit(h)) for h in (9.0, 1.0, 0.94)]
    fit = _fit(F.col("x1") - F.col("x0"), advances, lambda lines, at_least=None: first_fit(F.col("start.size"), least, heights, F.col("room"), lines, at_least=at_least))
    plans = plans.withColumn("fit", fit).withColumn("fitted_size", F.col("fit.size")).withColumn("fitted_line_height", F.col("fit.line_height"))
    return plans.withColumn("fitted_lines", F.col("fit.lines").cast("int")).drop("fit")


def _fit(width: Column, advances: DataFrame | None, fit: Callable[..., Column]) -> Column:
    """fit(lines, at_least) of rows (text, with advances also font), where lines(size) is the number of lines in the width."""
    if advances is None:
        return fit(characters(F.col("text"), width))
    metrics = M.Metrics(advances)
    told = lambda p: F.struct(p.alias("paragraphs"), M.total(p).alias("total"), M.widest(p).alias("widest"), metrics.space(F.col("font")).alias("space"), width.alias("width"))
    room = lambda k, size: F.floor(k["width"] * 1000 / size)
    lines = lambda k: lambda size: T.let(room(k, size), lambda r: M.wrapped(k["paragraphs"], k["space"], r))
    # Lines hold no more than the room, but for a glyph that is wider than that.
    at_least = lambda k: lambda size: F.when(k["widest"] <= room(k, size), F.ceil(k["total"] / F.greatest(room(k, size), F.lit(1)))).otherwise(0)
    return T.let(T.let(metrics.paragraphs(F.col("font"), F.col("text")), told), lambda k: fit(lines(k), at_least(k)))


def fit_overlay(boxes: DataFrame, advances: DataFrame | None = None) -> DataFrame:
    """Adds target (struct<x0, y0, x1, y1>) and overlay_size to boxes (x0, y0, x1, y1, text) of text in images.

    The target is the box with a little room around, at least so large that a word is legible; the size starts at 72 % of its height,
    within 7.5 and 18, and is null where nothing of 6 points fits. Advances count as in fit_size.
    """
    wide = F.struct((F.col("x0") - 1.5).alias("x0"), (F.col("y0") - 1.5).alias("y0"), (F.col("x1") + 1.5).alias("x1"), (F.col("y1") + 1.5).alias("y1"))
    small = lambda b: (G.width(b) < 12) | (G.height(b) < 8)
    grown = lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), (b["x0"] + F.greatest(F.lit(24.0), G.width(b))).alias("x1"), (b["y0"] + F.greatest(F.lit(12.0), G.height(b))).alias("y1"))
    boxes = boxes.withColumn("target", T.let(wide, lambda b: F.when(small(b), grown(b)).otherwise(b)))
    height = G.height(F.col("target"))
    start = F.greatest(F.lit(7.5), F.least(F.lit(18.0), height * 0.72))
    return boxes.withColumn("overlay_size", _fit(G.width(F.col("target")), advances, lambda lines, at_least=None: first_fit(start, 6.0, [F.lit(1.08)], height, lines, at_least=at_least))["size"])


def distinct_boxes(boxes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first of boxes that are equal to two decimals."""
    rounded = [F.bround(k, 2) for k in ("x0", "y0", "x1", "y1")]
    first = F.row_number().over(Window.partitionBy(*keys, *rounded).orderBy(order))
    return boxes.withColumn("__first", first).where("__first = 1").drop("__first")


def _apart(boxes: list) -> list[int]:
    """Kept boxes lie in cells twice as wide as the tolerance, by where they begin: one that is the same is in a cell's neighbours at most."""
    cells: dict[tuple[int, int], list] = {}
    kept = []
    for k, b in enumerate(boxes):
        edges = tuple(b[e] for e in ("x0", "y0", "x1", "y1"))
        if None not in edges:
            x, y = int(edges[0] // 1), int(edges[1] // 1)
            if any(all(abs(p - q) <= G.SAME for p, q in zip(edges, o)) for i in (x - 1, x, x + 1) for j in (y - 1, y, y + 1) for o in cells.get((i, j), ())):
                continue
            cells.setdefault((x, y), []).append(edges)
        kept.append(k)
    return kept


def apart_boxes(boxes: Column) -> Column:
    """Boxes in order without those that are the same, within tolerance, as one kept before."""

    @F.pandas_udf("array<int>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda boxes: None if boxes is None else _apart(list(boxes)))

    edges = F.transform(boxes, lambda b: F.struct(*[b[k].cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")]))
    return F.transform(run(edges), lambda k: F.get(boxes, k))


def missing_links(links: DataFrame, present: DataFrame) -> DataFrame:
    """Captured links (doc_id, page_index, x0..y1, kind, uri, target) that the page does not hold, each once."""
    key = lambda d: d.select(*PAGE, *[F.bround(k, 2).alias(k) for k in ("x0", "y0", "x1", "y1")], "kind", "uri", "target")
    want, have = key(links).distinct().alias("w"), key(present).distinct().alias("h")
    on = F.lit(True)
    for k in want.columns:
        on = on & F.col(f"w.{k}").eqNullSafe(F.col(f"h.{k}"))
    return want.join(have, on, "left_anti")


#: Code points of a bucket in which characters meet the ranges that cover some of it.
POINTS = 256


def covering_font(texts: DataFrame, coverage: DataFrame, key: str) -> DataFrame:
    """(key, font): the first font, by priority, that covers all characters of a text but white space, else the first of all.

    coverage (font, priority, first, last) lists ranges of code points. Each code point that occurs is looked up once, however many
    texts hold it: ranges are cut at buckets of POINTS, by which both sides meet.
    """
    chars = texts.select(key, F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), ""))).alias("c")).where((F.col("c") != "") & ~F.col("c").rlike(f"^{T.SPACE}$"))
    need = chars.select(key, F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("long").alias("point"))
    fonts = coverage.select("font", "priority").distinct()
    cut = coverage.select("font", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / POINTS), F.floor(F.col("last") / POINTS))).alias("bucket"))
    met = need.select("point").distinct().join(cut, (F.floor(F.col("point") / POINTS) == F.col("bucket")) & F.col("point").between(F.col("first"), F.col("last")))
    by_point = met.groupBy("point").agg(F.collect_set("font").alias("fonts")).withColumnRenamed("point", "point2")
    each = need.join(by_point, F.col("point") == F.col("point2"), "left").select(key, F.coalesce("fonts", F.array().cast("array<string>")).alias("fonts"))
    # The fonts that a text has in common to all of its characters: those that are named as often as it has characters.
    total = each.groupBy(key).agg(F.count("*").alias("total")).withColumnRenamed(key, "__key")
    named = each.select(key, F.explode("fonts").alias("font")).groupBy(key, "font").agg(F.count("*").alias("n"))
    full = named.join(total, (F.col(key) == F.col("__key")) & (F.col("n") == F.col("total"))).join(fonts, "font").groupBy(F.col(key).alias("__key")).agg(F.min_by("font", "priority").alias("font"))
    spare = fonts.agg(F.min_by("font", "priority")).first()[0]
    return texts.select(key).distinct().join(full, F.col(key) == F.col("__key"), "left").select(key, F.coalesce("font", F.lit(spare)).alias("font"))
