"""Lines, segments and samples of documents, and the admission policy for formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T

LINES_A_PAGE = 40
_ENDS = r"\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"
#: A whole blank line with its end: from the start of the text or an end of a line on, not from within a two-character end.
#: The first test, which costs least, is for what most characters are.
_BLANK_LINE = rf"(?![!-~])(?<![^{_ENDS}])(?!(?<=\r)\n)(?:[{T.SPACE}&&[^{_ENDS}]]*+(?:{T.LINE_END})|[{T.SPACE}&&[^{_ENDS}]]++\z)"


def lines(docs: DataFrame, keep_blank: bool = False) -> DataFrame:
    """(doc_id, line_no, line): the lines of each text, without their ends."""
    # Outer, as the optimizer would make a filter of the other kind, which splits all texts once more.
    out = docs.select("doc_id", F.posexplode_outer(F.split("text", T.LINE_END, -1)).alias("line_no", "line")).where("line_no is not null")
    return out if keep_blank else out.where(T.lstrip(F.col("line")) != "")


def pages(docs: DataFrame, lines_a_page: int = LINES_A_PAGE) -> DataFrame:
    """(doc_id, page_index, line_no, line): non-blank lines with white space collapsed, so many to a page."""
    return lines(docs).select("doc_id", F.floor(F.col("line_no") / lines_a_page).cast("int").alias("page_index"), "line_no", T.collapse(F.col("line")).alias("line"))


def formula_policy(page_lines: DataFrame) -> DataFrame:
    """One verdict a document from (doc_id, page_index, line): measures, and the reason why it is refused, or null."""
    one = F.when(P.formula_line(F.col("line")), 1).otherwise(0)
    by_page = page_lines.groupBy("doc_id", "page_index").agg(F.count("*").alias("n"), F.sum(one).alias("k"))
    by_doc = by_page.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.sum("n").alias("lines"),
        F.sum("k").alias("formula_lines"),
        F.count_if(F.col("k") > 0).alias("pages_with"),
        F.max("k").cast("long").alias("max_on_page"),
    )
    k, ratio = F.col("formula_lines"), F.col("formula_lines") / F.col("lines")
    reason = F.when((k >= 12) & (ratio >= 0.08), "formula_line_density").when((F.col("pages") >= 3) & (k >= 8) & (F.col("pages_with") / F.col("pages") >= 0.25), "formula_spread_across_pages").when((k >= 12) & (F.col("max_on_page") >= 8), "formula_dense_page")
    return by_doc.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, seg_no, segment, is_blank): runs of non-blank lines in one piece, each blank line by itself, line ends kept.

    Joined in order the segments are the text again. A text is cut within its row, before and after its blank lines: nothing is
    shuffled, and the work is linear in the text. A null text is one null segment.
    """
    mark, cut = "\x01a", "\x01b"  # of a text's own \x01 each becomes a mark, so that a cut is none of the text's characters
    marked = F.replace(F.col("text"), F.lit("\x01"), F.lit(mark))
    pieces = F.filter(F.split(F.regexp_replace(marked, _BLANK_LINE, f"{cut}$0{cut}"), cut), lambda s: s != "")
    own = F.transform(pieces, lambda s: F.when(F.contains(s, F.lit(mark)), F.replace(s, F.lit(mark), F.lit("\x01"))).otherwise(s))
    each = docs.select("doc_id", F.posexplode_outer(F.when(F.col("text") != "", own).otherwise(F.array("text"))).alias("seg_no", "segment"))
    return each.select("doc_id", "seg_no", "segment", (T.lstrip(F.col("segment")) == "").alias("is_blank"))


def join_segments(segs: DataFrame) -> DataFrame:
    """(doc_id, text) from ordered segments."""
    ordered = F.sort_array(F.collect_list(F.struct("seg_no", "segment")))
    return segs.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["segment"]), "").alias("text"))


def batches(rows: DataFrame, key: str, order: str, size: int = 50, most: int = 40, text: str = "text") -> DataFrame:
    """The non-blank rows with batch_no and offset: so many of a key's rows to a provider call, in order."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    n = max(1, min(size, most))
    kept = rows.where(T.strip(F.col(text)) != "").withColumn("__at", at)
    return kept.withColumn("batch_no", F.floor(F.col("__at") / n).cast("int")).withColumn("offset", (F.col("__at") % n).cast("int")).drop("__at")


def chunked(samples: Column, least: int = 320) -> Column:
    """array<string>: samples joined by spaces until so many characters are reached, then anew; what is left over at the end too."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        held, n = F.concat(acc["held"], F.array(s)), acc["n"] + F.length(s)
        full = n >= least
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(held, " ")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array().cast("array<string>")).otherwise(held).alias("held"),
            F.when(full, 0).otherwise(n).alias("n"),
        )

    return F.aggregate(samples, start, step, lambda acc: F.when(F.size(acc["held"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["held"], " ")))).otherwise(acc["done"]))


def detection_candidates(blocks: DataFrame, order: str, least: int = 24, limit: int = 18) -> DataFrame:
    """(doc_id, rank, text): of blocks (doc_id, text, kind), the first 2 * limit that tell something about their language."""
    text = T.collapse(F.col("text"))
    kept = blocks.withColumn("text", text).where((F.length("text") >= least) & ~P.not_sampled(F.col("text"), F.col("kind")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    return kept.withColumn("rank", rank).where(F.col("rank") <= 2 * limit).select("doc_id", "rank", "text")


def detection_samples(blocks: DataFrame, order: str, limit: int = 18) -> DataFrame:
    """(doc_id, chunk_no, chunk): candidates joined to chunks of 320 characters, at most limit; else the first non-blank blocks."""
    some = detection_candidates(blocks, order, limit=limit).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("s"))
    chunks = some.select("doc_id", F.slice(chunked(F.col("s")), 1, limit).alias("chunks"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    spare = blocks.withColumn("rank", first).where(F.col("rank") <= limit).withColumn("text", T.collapse(F.col("text"))).where("text <> ''")
    spare = spare.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("spare"))
    both = spare.join(chunks, "doc_id", "full").select("doc_id", F.posexplode(F.coalesce("chunks", "spare")).alias("chunk_no", "chunk"))
    return both


def first_rows(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most so many rows of each key, in order: blocks of an image that are used, samples of a page."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")
