"""Operators on hand-made rows."""

import collections
import difflib
import io
import random
import re
import zipfile

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioform import api
from folioform.functions import fixed, masking
from folioform.functions import geometry as G
from folioform.functions import predicates as P
from folioform.functions import text as T
from folioform.operators import layout as Y
from folioform.operators import lines as L
from folioform.operators import qa
from folioform.operators import translate as R
from folioform.plans.catalog import QUERIES
from folioform.sources import files, html


def one(spark, values, column, schema="t string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in df.withColumn("__i", F.monotonically_increasing_id()).select(column.alias("x"), "__i").orderBy("__i").collect()]


def test_native_text(spark):
    assert one(spark, ["ab", "a", "12", "a1b", "ab12", "  word ", "x²³", ""], P.native_text(F.col("t"))) == [True, False, False, True, False, True, False, False]


def test_html_text(spark):
    assert one(spark, ["abc", "&nbsp;", "&#160;", "1,234.5", "ab", "a1b", " "], P.html_text(F.col("t"))) == [True, False, False, False, False, True, False]


def test_whitespace_is_unicode(spark):
    assert one(spark, ["a   b\n", "　x　"], T.collapse(F.col("t"))) == ["a b", "x"]


def test_table_rows(spark):
    rows = ["dose 5 mg daily", "5 % more", "12%a", "•\tItem", "a\tb", "3 m² here", "3 m²x", "5 mgs"]
    assert one(spark, rows, P.table_row(F.col("t"))) == [True, False, True, False, True, True, False, False]


def test_line_rules(spark):
    assert one(spark, ["[12] x", "1. Abc", "Smith (2019) https://a", "plain"], P.reference_line(F.col("t"))) == [True, True, True, False]
    assert one(spark, ["References:", " Works  cited ", "References are"], P.reference_heading(F.col("t"))) == [True, True, False]
    assert one(spark, ["• x", "Figure 1", "figures", "2.1 Methods", "2.1 methods", "fig.a", "fig. a"], P.starts_structure(F.col("t"))) == [True, True, False, True, False, True, False]
    assert one(spark, ["page 3", "12", "http://x", "doi: 1", "a long line with page 3"], P.header_or_footer(F.col("t"))) == [True, True, True, True, False]


def test_noisy_sample_counts_a_share_of_whole_numbers(spark):
    assert one(spark, ["7" * d + "a" * 180 for d in (62, 63)] + ["7" * d + "a" * 340 for d in (118, 119)], P.noisy_sample(F.col("t"))) == [False, True, False, True]


def test_formula_lines(spark):
    rows = ["E = mc (1)", "sin(x) = 1", "a = b = c = d", "plain words only here", "x=1", "10 20 30"]
    assert one(spark, rows, P.formula_line(F.col("t"))) == [True, True, True, False, True, False]


def test_degenerate(spark):
    loop = "ar bheith i bhunaid " * 6
    pairs = [("short source text", loop), ("a" * 10, "b" * 200), ("one two three", "uno dos tres"), ("x", "y")]
    assert one(spark, pairs, P.degenerate(F.col("s"), F.col("d")), "s string, d string") == [True, True, False, False]


def test_join_hyphened(spark):
    pairs = [("bioecono-", "my"), ("a", "b"), ("", "b"), ("a ", " b"), ("a", "")]
    assert one(spark, pairs, T.join_hyphened(F.col("a"), F.col("b")), "a string, b string") == ["bioeconomy", "a b", "b", "a b", "a"]


def test_contact_identity(spark):
    rows = ["Ana Silva ZXQNT0QXZ", "Contact ZXQNT0QXZ", "Further information ZXQNT0QXZ", "please write to ZXQNT0QXZ soon", "Ana Silva"]
    assert one(spark, rows, P.contact_identity(F.col("t"))) == [True, False, True, False, False]


def test_masking_round_trip(spark):
    rows = ["Mail a.b@c.org, see https://x.org/y?z=1). Or @handle.", "no marks", "cost $5 \\ www.a.b/$1\\2 end", "é@abc x@yz"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").withColumn("m", masking.mask(F.col("t")))
    got = df.select("t", "m.masked", "m.replacements", masking.unmask(F.col("m.masked"), F.col("m.replacements")).alias("back")).collect()
    assert [r["back"] for r in got] == rows
    assert got[0]["masked"] == "Mail ZXQNT0QXZ, see ZXQNT1QXZ). Or ZXQNT2QXZ."
    assert got[0]["replacements"] == ["a.b@c.org", "https://x.org/y?z=1", "@handle"]
    assert got[3]["replacements"] == []


def test_unmask_other_forms(spark):
    df = spark.createDataFrame([("zxqnt 0 qxz and ZXQNT1 and OLPROTEGIDO0", ["A", "B"])], "t string, r array<string>")
    assert df.select(masking.unmask(F.col("t"), F.col("r"))).first()[0] == "A and B and A"


def test_replies(spark):
    rows = ['```json\n{"0": "a"}\n```', '{"1": "b"}', 'x {"2": "cd", "3', "nothing"]
    assert one(spark, rows, T.reply_map(F.col("t"))) == [{"0": "a"}, {"1": "b"}, {"2": "cd"}, {}]
    assert one(spark, ["```text\nhi\n```", " x ", "", "``` ```"], T.unfenced(F.col("t"))) == ["hi", "x", None, None]


def test_duration(spark):
    assert one(spark, [5.0, 65.25, 3725.5], T.duration(F.col("t")), "t double") == ["5.0s", "1m 5.2s", "1h 2m 5.5s"]


def test_segments(spark):
    text = "a\nb\n\nc\r\n\r\n  \nlast"
    got = L.segments(spark.createDataFrame([(1, text), (2, ""), (3, "x")], "doc_id long, text string")).orderBy("doc_id", "seg_no").collect()
    assert [(r["doc_id"], r["segment"]) for r in got] == [(1, "a\nb\n"), (1, "\n"), (1, "c\r\n"), (1, "\r\n"), (1, "  \n"), (1, "last"), (2, ""), (3, "x")]
    assert [r["is_blank"] for r in got][:6] == [False, True, False, True, True, False]


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab \n\r\t ", max_size=30), min_size=1, max_size=8))
def test_segments_join_to_the_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in L.join_segments(L.segments(docs)).collect()}
    assert back == dict(enumerate(texts))


def test_sample_chunks(spark):
    df = spark.createDataFrame([(["a" * 200, "b" * 200, "c" * 10],), ([],)], "s array<string>")
    got = [[len(x) for x in r[0]] for r in df.select(L.chunked(F.col("s"))).collect()]
    assert got == [[401, 10], []]


def _policy(spark, pages):
    rows = [(1, p, line) for p, lines in enumerate(pages) for line in lines]
    return L.formula_policy(spark.createDataFrame(rows, "doc_id long, page_index int, line string")).first()


def test_policy(spark):
    prose, eq = "plain words in a sentence here", "x = y + 1 (3)"
    assert _policy(spark, [[prose] * 20])["allowed"]
    assert _policy(spark, [[prose] * 10 + [eq] * 2])["allowed"]
    assert _policy(spark, [[prose] * 10 + [eq] * 14])["reason"] == "formula_line_density"
    assert _policy(spark, [[prose] * 200 + [eq] * 4, [prose] * 100 + [eq] * 4, [prose]])["reason"] == "formula_spread_across_pages"
    assert _policy(spark, [[prose] * 300 + [eq] * 12])["reason"] == "formula_dense_page"


def line(no, x0, y0, x1, text="Some words here", page=0, **other):
    base = {"doc_id": 1, "page_index": page, "line_id": no, "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y0) + 10.0, "text": text, "font_name": "helv", "font_size": 10.0, "r": 0.0, "g": 0.0, "b": 0.0, "raw_block_id": 0, "rotation": 0, "page_width": 550.0, "confidence": 1.0}
    return base | other


def test_reading_order_of_two_columns(spark):
    from folioform.schema import LINE

    rows = [line(0, 40, 20, 500, "Title")] + [line(1 + i, 40, 200 + 14 * i, 240, f"left {i}") for i in range(8)] + [line(9 + i, 300, 200 + 14 * i, 500, f"right {i}") for i in range(8)]
    df = spark.createDataFrame([tuple(r[f.name] for f in LINE.fields) for r in reversed(rows)], LINE)
    got = Y.reading_order(Y.detect_columns(df)).orderBy("order_no").collect()
    assert [r["text"] for r in got] == [r["text"] for r in rows]
    assert {r["column_index"] for r in got} == {None, 0, 1}


def _blocks(spark, rows, **options):
    from folioform.schema import LINE

    df = spark.createDataFrame([tuple(r[f.name] for f in LINE.fields) for r in rows], LINE)
    return Y.blocks(Y.reading_order(Y.detect_columns(df)), **options).orderBy("page_index", "block_no").collect()


def test_lines_merge_to_blocks(spark):
    got = _blocks(spark, [line(0, 40, 100, 300, "one long line of"), line(1, 40, 107, 300, "text goes on"), line(2, 40, 200, 300, "Far below.")])
    assert [(r["text"], r["line_count"], r["kind"]) for r in got] == [("one long line of text goes on", 2, "paragraph"), ("Far below.", 1, "line")]
    assert (got[0]["y0"], got[0]["y1"]) == (100.0, 117.0)


@pytest.mark.parametrize("change", [{"b": 1.0}, {"font_name": "bold"}, {"raw_block_id": 1}, {"rotation": 90}, {"text": "[3] Author"}, {"text": "• item"}, {"y0": 101.0, "y1": 111.0}, {"font_size": 12.0}])
def test_lines_that_stay_apart(spark, change):
    assert len(_blocks(spark, [line(0, 40, 100, 300, "one long line of"), line(1, 40, 108, 300, "text goes on") | change])) == 2


def test_hyphen_continuation(spark):
    rows = [line(0, 40, 100, 300, "the bioecono-"), line(1, 40, 110, 300, "my is here", raw_block_id=1)]
    assert [r["text"] for r in _blocks(spark, rows)] == ["the bioeconomy is here"]
    assert len(_blocks(spark, rows, hyphens=False)) == 2
    assert len(_blocks(spark, [rows[0] | {"text": "the year 19-"}, rows[1]])) == 2


def test_alignment(spark):
    cases = {"center": [(100, 300), (120, 280), (90, 310)], "right": [(100, 300), (150, 300), (120, 300)], "left": [(100, 300), (100, 250)]}
    for want, edges in cases.items():
        df = spark.createDataFrame([([(float(a), float(b)) for a, b in edges], "text")], "boxes array<struct<x0:double,x1:double>>, t string")
        assert df.select(Y.alignment(F.col("boxes"), F.col("t"))).first()[0] == want


def test_references(spark):
    def marks(texts):
        df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, no int, text string")
        return [r["is_reference"] for r in Y.mark_references(df, ["no"]).orderBy("no").collect()]

    assert marks(["a", "b", "References", "[1] x"]) == [False, False, True, True]
    assert marks(["References:", "a", "b", "c"]) == [False] * 4


def test_row_stitching(spark):
    def fits(*frags):
        df = spark.createDataFrame([(1, i, *map(float, f)) for i, f in enumerate(frags)], "row int, frag_no int, x0 double, x1 double, size double, r double, g double, b double")
        return Y.stitchable_rows(df, ["row"]).first()["stitchable"]

    a = (0, 50, 10, 0, 0, 0)
    assert fits(a, (60, 90, 10, 0, 0, 0))
    assert not fits(a, (120, 150, 10, 0, 0, 0))
    assert not fits(a, (40, 90, 10, 0, 0, 0))
    assert not fits(a, (60, 90, 20, 0, 0, 0))
    assert not fits(a, (60, 90, 10, 0, 0, 1))


def test_style_span(spark):
    spans = [("2", 20.0, "a", 0), ("longest text", 9.0, "b", 0), (None, 30.0, "c", 0)]
    df = spark.createDataFrame([(spans,)], "s array<struct<text:string,size:double,font:string,color:int>>")
    assert df.select(Y.style_span(F.col("s"))).first()[0]["font"] == "b"


def test_trimming_goes_in_order(spark):
    box = (0.0, 0.0, 100.0, 20.0)
    df = spark.createDataFrame([(box, [(0.0, 15.0, 100.0, 30.0), (0.0, 10.0, 100.0, 12.0)])], "b struct<x0:double,y0:double,x1:double,y1:double>, a array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert tuple(df.select(Y.trimmed(F.col("b"), F.col("a"))).first()[0]) == (0.0, 0.0, 100.0, 9.75)


def test_harmonize(spark):
    df = spark.createDataFrame([(1, i, "k", s) for i, s in enumerate([10.0, 10.0, 9.5, 6.5])] + [(1, 9, "two", 8.0), (1, 10, "two", 4.0)], "doc_id int, no int, key string, font_size double")
    got = {r["no"]: r["harmonized"] for r in Y.harmonize(df, ["doc_id"]).collect()}
    assert got == {0: 8.29, 1: 8.29, 2: 8.29, 3: 6.5, 9: 8.0, 10: 4.0}


def test_ocr_box_in_image(spark):
    df = spark.createDataFrame([((100, 250, 600, 750), (100.0, 200.0, 300.0, 500.0))], "b struct<x0:int,y0:int,x1:int,y1:int>, i struct<x0:double,y0:double,x1:double,y1:double>")
    assert tuple(df.select(G.from_thousandths(F.col("b"), F.col("i"))).first()[0]) == (120.0, 275.0, 220.0, 425.0)


class Scripted(R.Identity):
    """Fails as told, call by call, then serves."""

    def __init__(self, *errors):
        self.errors, self.calls = list(errors), 0

    def translate(self, texts, source, target):
        self.calls += 1
        error = self.errors.pop(0) if self.errors else None
        if error:
            raise error
        return ["first"] * len(texts)


def _desk(first, made):
    def second():
        made.append(1)
        return R.Dictionary({"x": "second"})

    return R.Desk([lambda: first, second])


def _asked(desk, document="d"):
    return desk.call(document, "translate", ["x"], "en", "fr")


def test_providers_in_order():
    made = []
    assert _asked(_desk(Scripted(), made)) == (["first"], 0) and not made  # the second is made when it is needed
    for error in (R.Unavailable(), ConnectionError()):
        p = Scripted(error)
        desk = _desk(p, made)
        assert [_asked(desk), _asked(desk)] == [(["second"], 1)] * 2 and p.calls == 1  # down for the rest of the document
        assert _asked(desk, "other") == (["first"], 0)
    p = Scripted(R.UnsupportedLanguage())
    desk = _desk(p, made)
    assert [_asked(desk), _asked(desk)] == [(["second"], 1), (["first"], 0)]  # this call alone
    assert len(made) == 3
    with pytest.raises(R.Unavailable):
        _asked(R.Desk([lambda: Scripted(R.Unavailable())]))
    with pytest.raises(KeyError):
        _asked(R.Desk([lambda: Scripted(KeyError()), R.Identity]))
    with pytest.raises(ValueError):
        R.makers("identity>none")


def test_provider_options(monkeypatch):
    class Reader(R.Identity):
        def __init__(self, prompt="Read all text.", max_tokens="2048"):
            self.prompt, self.max_tokens = prompt, int(max_tokens)

    monkeypatch.setitem(R.PROVIDERS, "reader", Reader)
    one, two = (m() for m in R.makers("reader?prompt=Only+words%3F&max_tokens=64 > reader"))
    assert (one.prompt, one.max_tokens, two.prompt, two.max_tokens) == ("Only words?", 64, "Read all text.", 2048)
    with pytest.raises(TypeError):
        R.makers("reader?other=1")[0]()
    with pytest.raises(ValueError):
        R.makers("reader?broken")


def test_fallback_in_the_dataflow(spark, monkeypatch):
    monkeypatch.setitem(R.PROVIDERS, "down", lambda: Scripted(R.Unavailable()))
    rows = spark.createDataFrame([(1, i, f"some words {i}") for i in range(5)], "k int, no int, text string")
    got = [r["final_text"] for r in R.translate_batches(rows, "k", "no", "down>marking", "en", "fr", 2).orderBy("no").collect()]
    assert got == [f"emos sdrow {i}" for i in range(5)]


def test_languages_are_detected(spark):
    english = "This is the story of a house that is on the hill and of all that was in it"
    other = "Voici une histoire assez longue pour dire quelque chose de sa langue"
    rows = spark.createDataFrame([("a", 0, english, "line"), ("a", 1, english, "line"), ("b", 0, other, "line"), ("c", 0, "", "line")], "doc_id string, no int, text string, kind string")
    assert {r["doc_id"]: r["source_lang"] for r in R.detect_languages(rows, "no", "identity").collect()} == {"a": "en", "b": None, "c": "en"}


def test_batches_call_counts(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["hello there", "", "aba", " ", "more words"])], "k int, no int, text string")
    got = {r["no"]: (r["final_text"], r["state"], r["calls"]) for r in R.translate_batches(rows, "k", "no", "marking", "en", "fr", 2).collect()}
    assert got[0] == ("olleh ereht", "translated", 1)
    assert got[2] == ("aba", "rejected", 1)  # the same text again after one more call
    assert got[1][1] == got[3][1] == "blank"
    assert got[4] == ("erom sdrow", "translated", 1)


def _must_retry(src, dst, source, target):
    """The rule in plain Python."""
    if source == target:
        return False
    a, b = (" ".join((x or "").split()).lower() for x in (src, dst))
    words, m = b.split(), difflib.SequenceMatcher(None, a, b)
    grams = collections.Counter(tuple(words[i : i + 4]) for i in range(len(words) - 3))
    tokens = re.findall("[a-zA-Z']+", b)
    english = sum(t in fixed.STOPWORDS for t in tokens)
    return any((
        b in ("", a),
        len(b) > max(2.4 * len(a), len(a) + 120),
        len(words) >= 16 and (len(set(words)) / len(words) < 0.4 or max(grams.values()) >= 3),
        len(a) >= 40 and (m.find_longest_match().size >= max(28, int(0.45 * len(a))) or m.ratio() > 0.82),
        source == "en" != target and len(tokens) >= 10 and english >= 6 and english / len(tokens) >= 0.22,
    ))


def test_suspicious_is_the_plain_rule(spark):
    rng = random.Random(4)
    words = "the house is red and big so we like it very much indeed la maison rouge est grande nous aimons of to in for with on by as".split()
    pairs = [("The house is red and big, so we like it very much indeed", d) for d in ("La maison est rouge", "The house is red and big, so we like it very much", "", None, "x " * 20, "the of to in for with on by as is")]
    for _ in range(300):
        a = [rng.choice(words) for _ in range(rng.randint(1, 30))]
        b = [w if rng.random() < rng.choice([0, 0.5, 0.9]) else rng.choice(words) for w in a] + [rng.choice(words)] * rng.choice([0, 0, 0, 5])
        pairs.append((" ".join(a), " ".join(b)))
    rows = [(s, d, rng.choice(["en", "fr"]), "fr") for s, d in pairs]
    got = R.suspicious(spark.createDataFrame(rows, "src string, dst string, source_lang string, target_lang string")).collect()
    wrong = [r for r in got if r["suspicious"] != _must_retry(r["src"], r["dst"], r["source_lang"], r["target_lang"])]
    assert not wrong and len(got) == len(rows)
    assert 50 < sum(r["suspicious"] for r in got) < 250


def test_a_reply_that_keeps_long_numbers_leaks(spark):
    """As a title of the tables' pages does under the stand-in that turns letters."""
    a = "Hean. Esanwh 2353820953013749 4550997810720808 thheed hand,"
    b = R.Cipher().translate([a], "en", "fr")[0]
    row = spark.createDataFrame([(a, b, "en", "fr")], "src string, dst string, source_lang string, target_lang string")
    assert R.suspicious(row).first()["suspicious"] and _must_retry(a, b, "en", "fr")


def test_batches_as_one_by_one(spark, data):
    """translate_batches over the conversations, against the same steps in plain Python."""
    rows = spark.read.parquet(f"{data}/conversations.parquet").where("conv_id < 60").select("conv_id", "turn", "text")
    got = {(r["conv_id"], r["turn"]): (r["final_text"], r["state"], r["calls"]) for r in R.translate_batches(rows, "conv_id", "turn", "marking", "en", "fr", 3).collect()}
    want, at = {}, collections.Counter()
    for k, turn, text in sorted(tuple(r) for r in rows.collect()):
        if not text.strip():
            want[k, turn] = (text, "blank", 0)
            continue
        reply, calls = R.Marking().translate([text], "en", "fr")[0], int(at[k] % 3 == 0)
        at[k] += 1
        bad = _must_retry(text, reply, "en", "fr")
        want[k, turn] = (text, "rejected", calls + bool(reply)) if bad else (reply, "translated", calls)
    assert got == want and len(want) > 50


def test_quality_flags(spark):
    rows = ['{"blocks_unplaced": 2, "segments_rejected": 0}', "{bad", None, '{"blocks_rejected": "x"}', "[1]"]
    assert one(spark, rows, qa.quality_flags(F.col("t"))) == [["unplaced_blocks"], [], [], [], []]


def test_html_nodes(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><p> one <b>two</b> three<!-- no --><p>four<br>five</body></html>"
    assert html.nodes_of(page) == [("title", "T"), ("style", "p{}"), ("p", " one "), ("b", "two"), ("p", " three"), ("p", "four"), ("p", "five")]
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    got = html.text_nodes(df).orderBy("node_id").collect()
    assert [(r["tag"], r["prefix_ws"], r["core"], r["suffix_ws"], r["translatable"]) for r in got] == [("p", " ", "one", " ", True), ("b", "", "two", "", True), ("p", " ", "three", "", True), ("p", "", "four", "", True), ("p", "", "five", "", True)]


def test_nodes_are_handed_on_before_a_batch_ends():
    """A task never holds the nodes of all pages of a batch."""
    page = "<p>" + "word " * 200_000 + "</p><b>x</b>"
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(40)), "html": [page] * 39 + [None]})
    out = list(html.node_batches(iter([batch]), "page_id", ("script",)))
    assert [r["page_id"] for b in out for r in b.to_pylist()] == [k for k in range(39) for _ in range(2)]
    assert max(b.num_rows for b in out) <= 10 and {b.schema.field("page_id").type for b in out} == {pa.int64()}


def test_html_is_written_back(spark):
    page = "<!DOCTYPE html>\n<html><head><title>a &amp; b</title><style>p > q {}</style></head>\n<body><p id='x' > one <b>t&lt;wo</b> three<!-- no --> <br/>four&nbsp;<p>five</body></html>\n"
    nodes = [x for x in html.nodes_of(page) if x[0] not in fixed.SKIPPED_TAGS]
    same = html.with_nodes(page, {})
    assert same == page
    assert html.nodes_of(html.with_nodes(page, {k: t for k, (_, t) in enumerate(nodes)})) == html.nodes_of(page)
    changed = html.with_nodes(page, {k: f"<{k}>" for k in range(len(nodes))})
    assert [t for tag, t in html.nodes_of(changed) if tag not in fixed.SKIPPED_TAGS] == [f"<{k}>" for k in range(len(nodes))]
    assert "<!-- no -->" in changed and "<p id='x' >" in changed and "p > q {}" in changed
    pages = api.Pages(spark.createDataFrame([(1, "<p> hello there <b>big world</b></p><script>var x</script>"), (2, None), (3, "")], "page_id long, html string"))
    done = pages.translate("marking", "en", "fr")
    assert {r["page_id"]: r["html"] for r in done.pages.collect()} == {1: "<p> olleh ereht <b>gib dlrow</b></p><script>var x</script>", 2: None, 3: ""}
    assert [tuple(r) for r in done.stats().collect()] == [(1, 2, 0, 0, 0, 1)]
    mapped = pages.mapped(spark.createDataFrame([("big world", "W & <w>")], "key string, value string"))
    assert mapped.pages.where("page_id = 1").first()["html"] == "<p> hello there <b>W &amp; &lt;w&gt;</b></p><script>var x</script>"
    assert [tuple(r) for r in mapped.stats().collect()] == [(1, 1, 1, 0, 0, 0)]


def _docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join("<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{t}</w:t></w:r>' for t in p) + "</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("media/x.bin", b"\x00\x01")
    return out.getvalue()


def test_office_round_trip(spark, tmp_path):
    (tmp_path / "a.DOCX").write_bytes(_docx([["Hello ", "world"], [" "], ["Bye"]]))
    (tmp_path / "b.txt").write_bytes("café".encode("cp1252"))
    found = files.read_files(spark, str(tmp_path), (".docx",))
    runs = files.office_runs(found)
    paras = {r["para"]: r["text"] for r in files.paragraphs(runs).collect()}
    assert paras == {0: "Hello world", 2: "Bye"}
    t = files.paragraphs(runs).where("para = 0").select("path", "part", "para", F.lit("Bonjour").alias("translation"))
    made = files.rewritten(found, files.written_runs(runs, t)).first()["content"]
    assert [r[3] for r in files.runs_of(bytes(made))] == ["Bonjour", "Bye"]
    with zipfile.ZipFile(io.BytesIO(bytes(made))) as z:
        assert z.read("media/x.bin") == b"\x00\x01"
    assert files.read_text(spark, str(tmp_path)).first()["text"] == "café"


def test_charsets():
    assert files.decode(b"\xef\xbb\xbfa") == "﻿a"
    assert files.decode(b"\x80") == "€"
    assert files.decode(b"\x81") == "\x81"


def test_boxes_apart(spark):
    boxes = [(0.0, 0.0, 10.0, 10.0), (0.4, 0.0, 10.0, 10.0), (0.8, 0.0, 10.0, 10.0), (50.0, 0.0, 60.0, 10.0)]
    df = spark.createDataFrame([(boxes,)], "b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert [tuple(x)[0] for x in df.select(Y.apart_boxes(F.col("b"))).first()[0]] == [0.0, 0.8, 50.0]


def test_colours_and_directions(spark):
    df = spark.createDataFrame([(0xFF8000, 0.0, -1.0), (0, 1.0, 0.0), (0, -1.0, 0.0), (0, 0.0, 1.0)], "c int, dx double, dy double")
    got = df.select(G.rgb(F.col("c")).alias("c"), G.rotation(F.col("dx"), F.col("dy")).alias("r")).collect()
    assert tuple(got[0]["c"]) == (1.0, 128 / 255, 0.0) and [r["r"] for r in got] == [90, 0, 180, 270]


def test_streamed_jobs_and_manifest(spark, tmp_path):
    from folioform.streaming.jobs import keep_manifest, new_jobs

    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "output_name string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = new_jobs(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = keep_manifest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["output_name"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_font_coverage_looks_at_whole_texts(spark, tmp_path):
    from folioform.plans.layout_queries import font_coverage

    spark.createDataFrame([(4, "a" * 250 + "\u0101"), (8, "a" * 250), (5, "a" * 250 + "\u0436")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["font"] for r in font_coverage(spark, str(tmp_path)).collect()} == {4: "wide", 8: "latin", 5: "latin"}
