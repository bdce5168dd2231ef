"""Blocks of the tables' lines against the merge rules in plain Python."""

import regex
from pyspark.sql import functions as F

from folioform.functions import predicates as P
from folioform.functions import text as T
from folioform.operators import layout as Y
from folioform.plans.layout_queries import placed



def java(pattern):
    """A pattern of the library for this engine."""
    return regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


SPACE = regex.compile(java(T.SPACE + "+"))


def flat(t):
    return SPACE.sub(" ", t).strip(" ")


def strip(t):
    return t.strip(T.SPACES)


def table_row(t):
    body = regex.sub(java(T.BULLET), "", t)
    return flat(body) != "" and ("\t" in body or bool(regex.search(java(P.MEASURE), flat(body))))


def plain(t):
    s = flat(t)
    low = s.lower()
    dated = regex.search(r"\(\p{Nd}{4}[a-z]?\)", s) and regex.search(r"(?:^|[^\p{L}\p{N}_])(?:https?://|doi[: ])", low)
    reference = regex.search(r"^\[\p{Nd}+\]", s) or regex.search(r"^\p{Nd}+\. +[A-Z]", s) or dated
    header = (len(s) <= 18 and regex.search(r"(?:^|[^\p{L}\p{N}_])page +\p{Nd}+(?:$|[^\p{L}\p{N}_])", low)) or regex.search(r"^\p{Nd}+$", s) or regex.search(r"(?:^|[^\p{L}\p{N}_])doi[: ]", low) or s.startswith("http")
    return not (table_row(s) or reference or header)


def starts(t):
    s = t.lstrip(T.SPACES)
    return bool(regex.search(java(T.BULLET), s) or regex.search(r"(?i)^(?:(?:figure|table|abstract|keywords|references)(?:$|[^\p{L}\p{N}_])|fig\.[\p{L}\p{N}_])", s) or regex.search(r"^\p{Nd}+(?:\.\p{Nd}+)*" + java(T.SPACE) + "+[A-Z]", s))


def joined(a, b):
    a, b = a.rstrip(T.SPACES), b.lstrip(T.SPACES)
    if not a or not b:
        return a or b
    return a[:-1] + b if a.endswith("-") else f"{a} {b}"


def merges(p, c):
    """Whether line c goes into block p."""
    size, gap = p["font_size"], c["y0"] - p["y1"]
    width = lambda x: x["x1"] - x["x0"]
    shared = min(p["x1"], c["x1"]) - max(p["x0"], c["x0"])
    boundary = regex.search(r"[.!?;]$", p["text"].rstrip(T.SPACES)) and regex.search(r"^\p{Lu}", c["text"].lstrip(T.SPACES))
    return (
        p["rotation"] == c["rotation"] == 0 and p["font_name"] == c["font_name"] and p["raw_block_id"] == c["raw_block_id"] and max(abs(p[k] - c[k]) for k in "rgb") <= 0.20
        and abs(size - c["font_size"]) <= max(0.75, size * 0.08) and -max(2.0, size * 0.55) <= gap <= max(size * 0.7, 4.0)
        and abs(c["x0"] - p["x0"]) <= max(size * 1.5, 18.0) and width(p) > 0 and width(c) > 0 and shared >= min(width(p), width(c)) * 0.35
        and (not p["multi_column"] or p["column_index"] == c["column_index"])
        and plain(c["text"]) and not table_row(c["text"]) and not starts(c["text"]) and p["plain"] and not strip(p["text"]).endswith(":")
        and not (gap > max(1.5, size * 0.18) and boundary)
    )


def grown(p, c):
    text = joined(p["text"], c["text"])
    return p | {"x0": min(p["x0"], c["x0"]), "y0": min(p["y0"], c["y0"]), "x1": max(p["x1"], c["x1"]), "y1": max(p["y1"], c["y1"]), "text": text, "plain": plain(text), "line_count": p["line_count"] + c["line_count"]}


def continues(p, c):
    size, gap = p["font_size"], c["y0"] - p["y1"]
    return (
        regex.search(r"\p{L}-$", p["text"].rstrip(T.SPACES)) and p["column_index"] == c["column_index"] and p["rotation"] == c["rotation"] == 0
        and regex.search(r"^\p{Ll}", c["text"].lstrip(T.SPACES)) and -max(2.0, size * 0.55) <= gap <= max(size * 0.7, 4.0)
    )


def folded(items, joins):
    out = []
    for c in items:
        if out and joins(out[-1], c):
            out[-1] = grown(out[-1], c)
        else:
            out.append(c)
    return out


def check(lines, hyphens):
    lines = Y.reading_order(Y.detect_columns(lines))
    pages = {}
    for r in lines.orderBy("doc_id", "page_index", "order_no").collect():
        r = r.asDict()
        pages.setdefault((r["doc_id"], r["page_index"]), []).append(r | {"line_count": 1, "plain": plain(r["text"]) and not table_row(r["text"])})
    want = {}
    for page, items in pages.items():
        merged = folded(items, merges)
        merged = folded(merged, continues) if hyphens else merged
        want |= {(*page, k): (b["text"], b["line_count"], round(b["y1"], 6)) for k, b in enumerate(merged)}
    got = {(r["doc_id"], r["page_index"], r["block_no"]): (r["text"], r["line_count"], round(r["y1"], 6)) for r in Y.blocks(lines, hyphens=hyphens).collect()}
    assert got == want
    assert any(n > 2 for _, n, _ in want.values())


def marked(spark, data):
    """Lines of the tables, some of which begin or end as the rules ask for."""
    heads = F.array(*map(F.lit, ["", "", "", "• ", "Figure 1 ", "2.1 Xy ", "5 mg ", "[3] ", "page 4 ", "doi:1 ", "", "lower "]))
    tails = F.array(*map(F.lit, ["", "", ".", ":", "-", " 12", "", "", ", 7 mg"]))
    p = placed(spark, data).where("doc_id < 60")
    return p.withColumn("text", F.concat(F.get(heads, (F.col("m") % 12).cast("int")), "text", F.get(tails, (F.col("m") % 9).cast("int"))))


def test_merged_lines(spark, data):
    check(placed(spark, data).where("doc_id < 60").where(P.native_text(F.col("text"))), False)
    check(marked(spark, data), False)


def test_words_that_lines_break_off(spark, data):
    broken = placed(spark, data).where("doc_id < 60").withColumn("text", F.when(F.col("m") % 3 == 0, F.concat(T.rstrip(F.col("text")), F.lit("-"))).otherwise(F.lower("text")))
    check(broken, True)
    check(marked(spark, data), True)
