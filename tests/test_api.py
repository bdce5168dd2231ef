"""The pipeline object and a run over a folder."""

import pytest
from pyspark.sql import functions as F

from folioform import api
from folioform.sources import files

from .test_operators import _docx


def test_texts(spark):
    docs = spark.createDataFrame([(1, "hello there\n\naba\n"), (2, "")], "doc_id long, text string")
    t = api.Texts(docs)
    done = t.translate("marking", "en", "fr")
    assert {r["doc_id"]: r["text"] for r in done.docs.collect()}[2] == ""
    assert {r["doc_id"]: (r["total"], r["translated"], r["rejected"]) for r in done.stats().collect()} == {1: (3, 1, 1), 2: (1, 0, 0)}
    m = t.mapped(spark.createDataFrame([("aba", "x")], "key string, value string"))
    assert {r["doc_id"]: r["text"] for r in m.docs.collect()} == {1: "hello there\n\nx\n", 2: ""}
    with pytest.raises(ValueError):
        t.translate("marking", "en", "en")
    with pytest.raises(ValueError):
        t.stats()
    assert t.allowed().docs.count() == 2 and {r["allowed"] for r in t.policy().collect()} == {True}


def test_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello there")
    (tmp_path / "in/b.docx").write_bytes(_docx([["Hello ", "world"], ["Bye now"]]))
    (tmp_path / "in/c.csv").write_text("no")
    got = api.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["fr", "en"], "en", "marking")
    assert sorted((r["output_name"], r["status"]) for r in got.collect()) == [("a_en.txt", "copied_source_language"), ("a_fr.txt", "translated"), ("b_en.docx", "copied_source_language"), ("b_fr.docx", "translated")]
    made = {r["output_name"]: bytes(r["content"]) for r in api.outputs(spark, str(tmp_path / "out"), "fr").collect()}
    assert made["a_fr.txt"] == b"olleh ereht"
    assert [r[3] for r in files.runs_of(made["b_fr.docx"])] == ["olleH dlrow", "eyB won"]
    again = api.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["fr", "en"], "en", "marking")
    assert again.count() == 4 and api.outputs(spark, str(tmp_path / "out"), "fr").count() == 2
    with pytest.raises(ValueError):
        api.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["xx"], "en")
    assert api.manifest(spark, str(tmp_path / "out")).where(F.col("status") == "translated").count() == 2


def test_folder_of_unknown_languages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    english = "This is the story of a house that is on the hill and of all that was in it"
    (tmp_path / "in/a.txt").write_text(english)
    (tmp_path / "in/b.docx").write_bytes(_docx([[english]]))
    (tmp_path / "in/c.txt").write_text("Voici une histoire assez longue pour dire quelque chose de sa langue")
    got = api.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["fr", "en"], None, "marking")
    assert {r["output_name"]: r["status"] for r in got.collect()} == {"a_en.txt": "copied_source_language", "a_fr.txt": "translated", "b_en.docx": "copied_source_language", "b_fr.docx": "translated", "c_en.txt": "failed", "c_fr.txt": "failed"}
    made = {r["output_name"]: bytes(r["content"]) for r in api.outputs(spark, str(tmp_path / "out"), "fr").collect()}
    assert sorted(made) == ["a_fr.txt", "b_fr.docx"] and made["a_fr.txt"].startswith(b"sihT si eht")
    assert sorted(r["output_name"] for r in api.outputs(spark, str(tmp_path / "out"), "en").collect()) == ["a_en.txt", "b_en.docx"]


FORMULAS = "\n".join(f"x_{k} = {k} + {k} * (y / 2) - 3 (1.{k})" for k in range(40))


def _folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello there\n\naba\n")
    (tmp_path / "in/f.txt").write_text(FORMULAS)
    (tmp_path / "in/b.docx").write_bytes(_docx([["Hello ", "world"]]))
    (tmp_path / "in/broken.docx").write_bytes(b"no archive")
    (tmp_path / "in/f.page").write_text(FORMULAS)
    (tmp_path / "in/g.page").write_text("plain words")
    return str(tmp_path / "in"), str(tmp_path / "out")


def _page_texts(found):
    return found.select("path", files.decoded(F.col("content")).alias("text"))


def test_every_input_has_a_row_that_says_what_happened(spark, tmp_path):
    """Texts are not subject to the policy, documents of an extractor are; a file that cannot be read has failed."""
    source, out = _folder(tmp_path)
    got = {r["output_name"]: r for r in api.run(spark, source, out, ["fr", "en"], "en", "marking", extractors={".page": _page_texts}).collect()}
    want = {"a": "translated", "f": "translated", "b": "translated", "broken": "failed", "f.page": "refused", "g.page": "translated"}
    names = {"a": "a_fr.txt", "f": "f_fr.txt", "b": "b_fr.docx", "broken": "broken_fr.docx", "f.page": "f_fr.page", "g.page": "g_fr.page"}
    assert {k: got[v]["status"] for k, v in names.items()} == want and len(got) == 12
    assert all(r["status"] == "copied_source_language" for k, r in got.items() if "_en." in k)
    assert (got["broken_fr.docx"]["reason"], got["f_fr.page"]["reason"], got["a_fr.txt"]["reason"]) == ("no_output", "formula_line_density", None)
    assert got["a_fr.txt"]["flags"] == ["rejected_segments"] and '"segments_rejected":1' in got["a_fr.txt"]["stats"] and got["f_fr.page"]["stats"] is None
    assert got["a_fr.txt"]["started"] is not None and got["a_fr.txt"]["took"].endswith("s") and got["a_fr.txt"]["source_lang"] == "en"
    assert sorted(r["output_name"] for r in api.outputs(spark, out, "fr").collect()) == ["a_fr.txt", "b_fr.docx", "f_fr.txt", "g_fr.page"]


@pytest.mark.parametrize("dies", ["put", "publish"])
def test_a_run_that_dies_has_done_nothing(spark, tmp_path, monkeypatch, dies):
    """The first run dies before its manifest is written, or before it is published; the next one does all work once."""
    from folioform.sources.runs import Runs

    source, out = _folder(tmp_path)
    whole = getattr(Runs, dies)

    def broken(self, *a):
        if dies == "publish" or a[1] == "manifest":
            raise RuntimeError("lost")
        return whole(self, *a)

    monkeypatch.setattr(Runs, dies, broken)
    with pytest.raises(RuntimeError):
        api.run(spark, source, out, ["fr"], "en", "marking")
    monkeypatch.undo()
    assert api.outputs(spark, out, "fr").count() == 0
    with pytest.raises(ValueError):
        api.manifest(spark, out)
    for k in range(2):
        got = api.run(spark, source, out, ["fr"], "en", "marking")
        assert sorted((r["output_name"], r["status"]) for r in got.collect()) == [("a_fr.txt", "translated"), ("b_fr.docx", "translated"), ("broken_fr.docx", "failed"), ("f_fr.txt", "translated")]
        made = api.outputs(spark, out, "fr").collect()
        assert sorted(r["output_name"] for r in made) == ["a_fr.txt", "b_fr.docx", "f_fr.txt"] and len({r["run"] for r in made}) == 1
    left = spark.read.parquet(f"{out}/fr").groupBy("output_name").count().where("count > 1").count()
    assert left == 3  # what the dead run wrote lies there still, unseen
    runs = Runs(spark, out)
    assert len(runs.sweep()) == 1 and runs.sweep() == [] and spark.read.parquet(f"{out}/fr").count() == 3
    again = api.run(spark, source, out, ["fr"], "en", "marking", overwrite=True)
    newest = runs.published()[-1]
    assert len(runs.published()) == 3 and again.where(F.col("run") == newest).count() == 4
    assert [r["run"] for r in api.outputs(spark, out, "fr").collect()] == [newest] * 3


def test_mappings_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello there\n\nbye\n")
    (tmp_path / "in/b.html").write_text("<p> hello there </p><i>stay</i>")
    (tmp_path / "map.json").write_text('{"hello there": "bonjour"}')
    assert api.main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--mapping", str(tmp_path / "map.json")]) == 0
    assert "translated: 2" in capsys.readouterr().out
    made = {r["output_name"]: bytes(r["content"]) for r in api.outputs(spark, str(tmp_path / "out"), "mapped").collect()}
    assert made == {"a_mapped.txt": b"bonjour\n\nbye\n", "b_mapped.html": b"<p> bonjour </p><i>stay</i>"}
