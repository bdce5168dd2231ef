"""The document formats: reading many files to a task, writing files together."""

import os

import pytest
from pyspark.sql import functions as F

from folioform import schema
from folioform.sources import files, office

from .test_operators import _docx


@pytest.fixture(scope="module")
def formats(spark):
    office.register(spark)
    return spark


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep/er").mkdir(parents=True)
    for k in range(12):
        (tmp_path / f"deep/d{k:02}.docx").write_bytes(_docx([["Hello ", f"world {k}"], [" "], ["Bye"]]))
    (tmp_path / "deep/er/broken.DOCX").write_bytes(b"no archive")
    (tmp_path / "deep/a.txt").write_bytes("naïve".encode("cp1252"))
    (tmp_path / "deep/p.html").write_bytes(b"<p>one<b>two</b></p>")
    (tmp_path / "deep/_stage-x").mkdir()
    (tmp_path / "deep/_stage-x/half.docx").write_bytes(_docx([["never"]]))
    return str(tmp_path / "deep")


def test_one_file_many_rows_many_files_one_task(formats, folder):
    df = formats.read.format("folioform-office").load(folder)
    assert df.schema == schema.RUN and df.rdd.getNumPartitions() == 1
    rows = [tuple(r) for r in df.collect()]
    plain = [tuple(r) for r in files.office_runs(files.read_files(formats, folder, (".docx",)).withColumn("path", F.regexp_replace("path", "^file:", ""))).collect()]
    assert sorted(rows) == sorted(r for r in plain if "_stage" not in r[0]) and len(rows) == 36
    size = os.path.getsize(f"{folder}/d00.docx")
    few = formats.read.format("folioform-office").option("taskBytes", 3 * size + 100).load(folder)
    assert 4 <= few.rdd.getNumPartitions() <= 6 and sorted(tuple(r) for r in few.collect()) == sorted(rows)
    assert formats.read.format("folioform-office").load(f"file://{folder}").count() == 36
    with pytest.raises(Exception, match="broken"):
        formats.read.format("folioform-office").option("badFiles", "fail").load(folder).count()


def test_texts_and_nodes(formats, folder):
    assert [r["text"] for r in formats.read.format("folioform-text").load(folder).collect()] == ["naïve"]
    nodes = formats.read.format("folioform-html").load(folder).orderBy("node_no").collect()
    assert [(r["node_no"], r["tag"], r["text"]) for r in nodes] == [(0, "p", "one"), (1, "b", "two")]
    with pytest.raises(Exception, match="nowhere"):
        formats.read.format("folioform-text").load(folder + "/nowhere").count()


def test_written_files_appear_together(formats, tmp_path):
    out = str(tmp_path / "out")
    made = formats.range(40).select(F.format_string("f%02d.docx", "id").alias("name"), F.lit(_docx([["one"], ["two"]])).alias("content")).repartition(4)
    made.write.format("folioform-files").mode("append").save(out)
    back = formats.read.format("folioform-office").load(out)
    assert back.count() == 80 and back.select(F.regexp_extract("path", "([^/]*)$", 1)).distinct().count() == 40
    assert formats.read.format("folioform-files").load(out).select(F.length("content").alias("n")).distinct().count() == 1

    @F.udf("binary")
    def failing(k):
        if k == 35:
            raise RuntimeError("lost")
        return b"half"

    with pytest.raises(Exception, match="lost"):
        formats.range(40).select(F.format_string("g%02d.docx", "id").alias("name"), failing("id").alias("content")).repartition(4).write.format("folioform-files").mode("append").save(out)
    assert not [n for n in os.listdir(out) if n.startswith("_")] and formats.read.format("folioform-files").load(out).count() == 40
    with pytest.raises(Exception, match="null"):
        formats.sql("select cast(null as string) as name, cast('x' as binary) as content").write.format("folioform-files").mode("append").save(out)
    with pytest.raises(Exception, match="name string, content binary"):
        formats.range(1).write.format("folioform-files").mode("append").save(out)
    formats.createDataFrame([("only.txt", bytearray(b"x"))], "name string, content binary").write.format("folioform-files").mode("overwrite").save(out)
    assert [bytes(r["content"]) for r in formats.read.format("folioform-files").load(out).collect()] == [b"x"]
    empty = formats.createDataFrame([], "name string, content binary")
    empty.write.format("folioform-files").mode("overwrite").save(out)
    assert formats.read.format("folioform-files").load(out).count() == 0


def test_round_trip_through_new_runs(formats, folder, tmp_path):
    """Runs read by the format, written into their files, and read again."""
    found = files.read_files(formats, folder, (".docx",)).where(~F.col("path").contains("_stage"))
    runs = formats.read.format("folioform-office").load(folder).withColumn("path", F.concat(F.lit("file:"), "path"))
    new = runs.withColumn("new_text", F.upper("text"))
    made = files.rewritten(found, new).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")
    made.write.format("folioform-files").mode("append").save(str(tmp_path / "again"))
    again = formats.read.format("folioform-office").load(str(tmp_path / "again"))
    cut = lambda df, c: sorted((r[0].rsplit("/", 1)[1], r["part"], r["para"], r["run"], r[c]) for r in df.collect())
    assert cut(again, "text") == cut(new, "new_text")
