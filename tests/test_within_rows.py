"""Work that stays in the JVM and in its row: charsets, segments, fonts by buckets, a bound before texts are compared."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from folioform.operators import layout, lines
from folioform.operators import translate as R
from folioform.sources import files


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_charsets_of_all_bytes(spark):
    data = [bytes([b]) for b in range(256)] + [bytes([b]) + b"\xe9 x" for b in range(128, 256)] + [bytes([b, c]) for b in range(0xC0, 0x100) for c in (0x20, 0x80, 0x9D, 0xBF)]
    data += [b"", "naïve – “x”".encode(), "naïve – “x”".encode("cp1252"), b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc0\xaf", b"\xef\xbb\xbfx", bytes(range(256)), "𝒳é".encode()]
    df = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(data)] + [(-1, None)], "k int, data binary").select("k", files.decoded(F.col("data")).alias("text"))
    got = {r["k"]: r["text"] for r in df.collect()}
    assert got == {k: files.decode(x) for k, x in enumerate(data)} | {-1: None}
    assert "Python" not in plan_of(df) and "Arrow" not in plan_of(df)


def plain_segments(text):
    out, blank = [], True
    for line in text.splitlines(keepends=True) or [text]:
        now = not line.strip()
        if now or blank or not out:
            out.append(line)
        else:
            out[-1] += line
        blank = now
    return out


def test_segments_within_a_row(spark):
    """A million lines are cut in their row, without a window or an exchange."""
    texts = ["", "\n", "a", "a\nb\n\n\nc", " \r\nx\ry\x0b\x0c z", "\n\na\n", "a b\x85 \n\nq  "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = {}
    for r in lines.segments(df).orderBy("doc_id", "seg_no").collect():
        got.setdefault(r["doc_id"], []).append((r["segment"], r["is_blank"]))
    for k, t in enumerate(texts):
        assert [s for s, _ in got[k]] == plain_segments(t) and all(b == (not s.strip()) for s, b in got[k])
    assert got[99] == [(None, None)]
    long = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.when(i % 10 == 0, "").otherwise(F.concat(F.lit("line "), i.cast("string")))), "\n").alias("text"))
    out = lines.segments(long)
    assert not {"Window", "Exchange"} & set(plan_of(out).replace("(", " ").split())
    assert out.agg(F.count("*"), F.max("seg_no"), F.sum(F.length("segment"))).first() == (199_999, 199_998, long.select(F.length("text")).first()[0])


def test_fonts_meet_characters_by_buckets(spark):
    ranges = [("a", 1, 0, 255), ("b", 2, 0x370, 0x3FF), ("b", 2, 0, 127), ("c", 3, 0, 0x10FFFF)]
    coverage = spark.createDataFrame(ranges, "font string, priority int, first long, last long")
    texts = [(1, "plain"), (2, "ωμέγα plus"), (3, "é ω"), (4, ""), (5, "𝒳"), (6, None), (7, "ÿĀ")]
    got = layout.covering_font(spark.createDataFrame(texts, "id int, text string"), coverage, "id")
    assert {r["id"]: r["font"] for r in got.collect()} == {1: "a", 2: "b", 3: "c", 4: "a", 5: "c", 6: "a", 7: "c"}
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_few_rows_are_compared_in_order(spark):
    """The bound never rules a leak out, and lets few of unlike rows through."""
    en = "This is the story of a house that stood on the hill above the river, and of all the people who lived in it"
    fr = [f"Voici {w} récit d'une maison, quinze jours après; quelques voisins y logeaient puis partirent vers {w}-ville" for w in ("bref", "long", "quatrième", "faux", "joli", "vague")]
    rows = [(k, "de", "fr", en, x) for k, x in enumerate([*fr, en[:60] + fr[0][:40], en[::-1], en.replace("house", "hut"), en.upper() + " x", "1 " * 60, en[50:] + en[:50]])]
    df = spark.createDataFrame(rows, "k int, source_lang string, target_lang string, src string, dst string")
    got = {r["k"]: r["suspicious"] for r in R.suspicious(df).collect()}
    bounds = {r["k"]: r["n"] for r in df.select("k", R.shared_at_most(F.lower("src"), F.lower("dst")).alias("n")).collect()}
    passed = 0
    for k, _, _, a, b in rows:
        x, y = " ".join(a.lower().split()), " ".join(b.lower().split())
        m = SequenceMatcher(None, x, y)
        longest, matched = m.find_longest_match().size, sum(z.size for z in m.get_matching_blocks())
        assert longest <= bounds[k] and matched <= bounds[k]
        leak = longest >= max(28, int(len(x) * 0.45)) or m.ratio() > 0.82
        if k not in (10,):  # decided before
            assert got[k] == leak, k
        passed += bounds[k] >= max(28, int(len(x) * 0.45)) or 2 * bounds[k] / (len(x) + len(y)) > 0.82
    assert sum(got.values()) >= 4 and passed < len(rows)


@pytest.mark.parametrize("text", ["aab", "", "é€é", "a.b.c(*"])
def test_shared_characters(spark, text):
    other = "ab€(é.é"
    n = spark.range(1).select(R.shared_at_most(F.lit(text), F.lit(other)).alias("n")).first()["n"]
    assert n == sum(min(text.count(c), other.count(c)) for c in set(text))
