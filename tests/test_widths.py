"""Lines and sizes by advances, against the same rules in plain Python."""

import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioform.functions import geometry as G
from folioform.functions import widths as M
from folioform.operators import layout as Y


def lines(text, width, space, room):
    n = 0
    for written in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        n, x, first = n + 1, 0, True
        for word in written.split(" "):
            own = sum(map(width, word))
            if not first and x + space + own <= room:
                x += space + own
            else:
                n, x = n + (not first), 0
                for c in word:
                    if own > room and x > 0 and x + width(c) > room:
                        n, x = n + 1, 0
                    x += width(c)
            first = False
    return n


def width_in(table):
    return lambda c: next((w for w, chars in table.items() if c in chars), M.UNKNOWN)


def test_every_ascii_character_has_one_advance():
    for table in (M.REGULAR, M.BOLD):
        assert sorted("".join(table.values())) == sorted(map(chr, range(0x20, 0x7F)))


def test_advances_of_letters_with_marks(spark):
    own = M.advances_by_code(M.base_advances(spark))
    assert own["helv"][ord("é")] == own["helv"][ord("e")] == own["heit"][ord("ë")] == 556
    assert own["helv"][ord("í")] == 278 and own["helv"][ord("i")] == 222 and own["hebo"][ord("Ł")] == M.UNKNOWN


def test_tables_of_advances(spark):
    rows = [("f", 65, 700), ("f", 65, 600), ("f", None, 1), ("f", -1, 1), ("f", 67, -5), (None, 66, 1), ("g", 66, 100)]
    assert M.advances_by_code(spark.createDataFrame(rows, "font string, code int, advance int")) == {"f": [500] * 65 + [700], "g": [500] * 66 + [100]}
    assert M.advances_by_code(spark.createDataFrame([], "font string, code int, advance int")) == {}


@pytest.fixture(scope="module")
def wrap(spark):
    metrics = M.Metrics(M.base_advances(spark))

    def go(rows):
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, font string, text string, room int")
        got = df.select("k", M.wrapped(metrics.paragraphs(F.col("font"), F.col("text")), metrics.space(F.col("font")), F.col("room")).alias("n"))
        return [r["n"] for r in got.orderBy("k").collect()]

    return go


def test_lines_at_the_edges(wrap):
    rows = [("helv", "", 100), ("helv", None, 100), ("helv", "aa aa", 2502), ("helv", "aa aa", 2501), ("helv", "aaaa", 1112), ("helv", "b aaaaa b", 1112), ("helv", "a\n\na", 9999), ("helv", "😀😀", 999), ("none", "ab", 999), ("helv", "aaa", 1)]
    assert wrap(rows) == [1, None, 1, 2, 2, 5, 3, 2, 2, 3]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["helv", "hebo"]), st.text(string.ascii_letters + " .,\n@|", max_size=60), st.integers(1, 6000)), min_size=40, max_size=40))
def test_lines_are_those_of_plain_rules(wrap, rows):
    tables = {"helv": width_in(M.REGULAR), "hebo": width_in(M.BOLD)}
    assert wrap(rows) == [lines(text, tables[font], 278, room) for font, text, room in rows]


def test_sizes_are_the_first_that_fit(spark):
    texts = ["word " * 9, "W" * 80, "iiii " * 40, "", "a b", "word " * 500, None]
    df = spark.createDataFrame([(k, t, "helv", 0.0, 150.0, 12.0) for k, t in enumerate(texts)], "k int, text string, font string, x0 double, x1 double, font_size double")
    df = df.withColumn("start", G.start_size(F.lit("paragraph"), F.col("font_size"))).withColumn("room", F.lit(40.0))
    got = {r["k"]: r for r in Y.fit_size(df, advances=M.base_advances(spark)).collect()}
    wide = width_in(M.REGULAR)
    for k, text in enumerate(texts):
        sizes = [12.0 * 0.92**i for i in range(12)]
        fits = [(s, h) for h in (1.18, 1.0, 0.94) for s in sizes if text is not None and s >= 6.49 and lines(text, wide, 278, int(150_000 / s)) * s * h <= 40]
        assert (got[k]["fitted_size"], got[k]["fitted_line_height"]) == (pytest.approx(fits[0]) if fits else (None, None))


def test_no_python_and_no_shuffle(spark):
    df = spark.range(10).selectExpr("cast(id as string) text", "'helv' font", "struct(12.0d size, 1.18d line_height) start", "0.0d x0", "90.0d x1", "30.0d room")
    plan = Y.fit_size(df, advances=M.base_advances(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_overlays_by_advances(spark):
    df = spark.createDataFrame([("iiiiiiiiiiiiiiii", "helv"), ("WWWWWWWWWWWWWWWW", "helv"), ("W" * 400, "helv")], "text string, font string")
    df = df.selectExpr("*", "0.0d x0", "0.0d y0", "80.0d x1", "20.0d y1")
    got = [r["overlay_size"] for r in Y.fit_overlay(df, M.base_advances(spark)).collect()]
    assert got[0] == pytest.approx(23 * 0.72) and got[1] < got[0] and got[2] is None


def test_sizes_at_which_even_the_fewest_lines_do_not_fit_are_not_counted(spark):
    never = lambda size: F.raise_error(F.lit("counted")).cast("long")
    fit = Y.first_fit(F.col("s"), 6.5, [F.lit(1.0)], F.lit(36.0), never, at_least=lambda size: F.lit(99))
    assert spark.createDataFrame([(10.0,)], "s double").select(fit.alias("fit")).first()["fit"] is None


def test_narrow_boxes_and_empty_texts_fit_as_their_lines_are_counted(spark):
    """No bound on lines divides by a room of nothing or goes beyond the count."""
    rows = [(x1, text) for x1 in (-5.0, 0.0, 0.001, 3.0, 9.0, 60.0, 200.0) for text in ("", " ", "W", "iii", "WWWW iii\n\nl", "the quick brown fox jumps over it", "m" * 90)]
    p = spark.createDataFrame(rows, "x1 double, text string").selectExpr("'helv' as font", "named_struct('size', 10.25D, 'line_height', 1.18D) as start", "0.0D as x0", "x1", "36.0D as room", "text")
    metrics = M.Metrics(M.base_advances(spark))
    lines = lambda size: M.wrapped(metrics.paragraphs(F.col("font"), F.col("text")), metrics.space(F.col("font")), F.floor((F.col("x1") - F.col("x0")) * 1000 / size))
    plain = Y.first_fit(F.col("start.size"), 6.5, [F.lit(h) for h in (1.18, 1.0, 0.94)], F.col("room"), lines)
    got = Y.fit_size(p, advances=M.base_advances(spark)).withColumn("plain", plain).collect()
    assert len(got) == len(rows) and all((r["fitted_size"], r["fitted_lines"]) == ((r["plain"]["size"], r["plain"]["lines"]) if r["plain"] else (None, None)) for r in got)
