"""A lazy pipeline over documents, and the same from the command line (python -m folioform)."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fixed
from .functions import text as T
from .operators import jobs, lines, qa
from .operators import translate as R
from .sources import files, html
from .sources.runs import Runs


@dataclass(frozen=True)
class Texts:
    """Text documents (doc_id, text) on their way; every method returns a new one or a DataFrame, nothing runs before that is read."""

    docs: DataFrame
    done: DataFrame | None = None  # segments with their translation, state and calls

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Texts:
        """Text files of any charset; a document's id is its path."""
        return cls(files.read_text(spark, path).select(F.col("path").alias("doc_id"), "text"))

    def policy(self) -> DataFrame:
        """The verdict on each document's formulas."""
        return lines.formula_policy(lines.pages(self.docs))

    def allowed(self) -> Texts:
        """Without the documents that the policy refuses."""
        refused = self.policy().where("not allowed").select("doc_id")
        return replace(self, docs=self.docs.join(refused, "doc_id", "left_anti"))

    def segments(self) -> DataFrame:
        return lines.segments(self.docs)

    def languages(self, provider: str) -> DataFrame:
        """(doc_id, source_lang): the provider's word on samples of each document, null if it has none."""
        blocks = self.segments().select("doc_id", "seg_no", F.col("segment").alias("text"), F.lit("line").alias("kind"))
        return R.detect_languages(blocks, "seg_no", provider)

    def translate(self, provider: str, source: str | None, target: str, batch_size: int = 50) -> Texts:
        """Segments translated in batches; what is rejected stays as it is. Equal languages are an error.

        Without a source language each document's own is detected, or is source_lang where docs bring that; documents in the target language or in an unknown one stay.
        Providers can be named in order, as in "first>second".
        """
        if source == target:
            raise ValueError(f"source and target language are the same: {source}")
        segs = self.segments().withColumnRenamed("segment", "text")
        if source is None and "source_lang" in self.docs.columns:
            segs = segs.join(self.docs.select(F.col("doc_id").alias("__id"), "source_lang"), F.col("doc_id") == F.col("__id")).drop("__id")
        elif source is None:
            segs = segs.join(self.languages(provider).withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").drop("__id")
        done = R.translate_batches(segs, "doc_id", "seg_no", provider, source, target, batch_size)
        texts = lines.join_segments(done.select("doc_id", "seg_no", F.col("final_text").alias("segment")))
        return Texts(texts, done)

    def written(self, put: Callable[[DataFrame], DataFrame]) -> Texts:
        """The same from segments that put has written, so that texts and counters of one translation ask the provider once."""
        if self.done is None:
            raise ValueError("nothing is translated yet")
        done = put(self.done)
        return Texts(lines.join_segments(done.select("doc_id", "seg_no", F.col("final_text").alias("segment"))), done)

    def mapped(self, mapping: DataFrame) -> Texts:
        """Segments replaced where the mapping (key, value) holds their stripped text."""
        out = R.replace_mapped(self.segments().withColumnRenamed("segment", "text"), mapping)
        state = F.when(T.strip(F.col("text")) == "", "blank").when(F.col("replaced"), "translated").otherwise("skipped")
        return Texts(lines.join_segments(out.select("doc_id", "seg_no", F.col("new_text").alias("segment"))), out.select("doc_id", state.alias("state"), F.lit(0).alias("calls")))

    def stats(self) -> DataFrame:
        """Counters of each document after translate or mapped."""
        if self.done is None:
            raise ValueError("nothing is translated yet")
        return qa.segment_stats(self.done, "doc_id")


@dataclass(frozen=True)
class Pages:
    """HTML pages (page_id, html) on their way."""

    pages: DataFrame
    done: DataFrame | None = None  # nodes with new_text, state, retried and calls

    def nodes(self) -> DataFrame:
        return html.text_nodes(self.pages)

    def _with(self, nodes: DataFrame) -> Pages:
        return Pages(html.rewritten_pages(self.pages, nodes).select("page_id", "html"), nodes)

    def translate(self, provider: str, source: str, target: str, batch_size: int = 50) -> Pages:
        """Translatable text nodes translated in batches and put back; markup and all other nodes stay."""
        if source == target:
            raise ValueError(f"source and target language are the same: {source}")
        nodes = self.nodes()
        asked = nodes.where("translatable").select("page_id", "node_id", F.col("core").alias("text"))
        got = R.translate_batches(asked, "page_id", "node_id", provider, source, target, batch_size).select(F.col("page_id").alias("__page"), F.col("node_id").alias("__node"), "final_text", "state", "calls", "retried")
        both = nodes.join(got, (F.col("page_id") == F.col("__page")) & (F.col("node_id") == F.col("__node")), "left").drop("__page", "__node")
        return self._with(html.replaced_nodes(both.withColumn("translation", F.when(F.col("state") == "translated", F.col("final_text")))))

    def mapped(self, mapping: DataFrame) -> Pages:
        """Text nodes replaced where the mapping (key, value) holds their stripped text."""
        nodes = self.nodes().withColumn("text", F.concat("prefix_ws", "core", "suffix_ws"))
        out = R.replace_mapped(nodes, mapping)
        return self._with(out.withColumn("new_text", F.when(F.col("replaced"), F.col("new_text"))).withColumn("state", F.when(F.col("replaced"), "translated").otherwise("skipped")).withColumn("calls", F.lit(0)).withColumn("retried", F.lit(False)))

    def stats(self) -> DataFrame:
        """Counters of each page after translate or mapped."""
        if self.done is None:
            raise ValueError("nothing is translated yet")
        some = lambda c: F.coalesce(c, F.lit(False))
        nodes = self.done.select("page_id", F.col("new_text").isNotNull().alias("applied"), some(F.col("retried")).alias("retried"), some(F.col("state") == "rejected").alias("rejected"), F.coalesce("calls", F.lit(0)).alias("calls"))
        return qa.html_stats(nodes, "page_id")


def translate_office(found: DataFrame, provider: str, source: str | None, target: str, batch_size: int = 50, keep: Callable[[DataFrame], DataFrame] = lambda done: done) -> DataFrame:
    """(path, content) of Word and PowerPoint files with their paragraphs translated; each goes into its first run.

    With source None the files bring source_lang. keep is given the paragraphs with their replies and gives back what is used of them:
    a table they were written to, so that the provider is asked once. Files that cannot be read are left out.
    """
    runs = files.office_runs(found)
    keyed = files.paragraphs(runs).withColumn("at", F.concat_ws("\n", "part", F.lpad(F.col("para").cast("string"), 9, "0")))
    if source is None:
        keyed = keyed.join(found.select("path", "source_lang"), "path")
    done = keep(R.translate_batches(keyed, "path", "at", provider, source, target, batch_size)).where("state = 'translated'")
    spread = done.select("path", F.split("at", "\n")[0].alias("part"), F.split("at", "\n")[1].cast("int").alias("para"), F.col("final_text").alias("translation"))
    return files.rewritten(found, files.written_runs(runs, spread))


def file_languages(texts: DataFrame, office: DataFrame, provider: str) -> DataFrame:
    """(path, source_lang) of texts (path, text) and office files (path, content), told by the provider from samples; null if it cannot tell."""
    told = Texts(texts.select(F.col("path").alias("doc_id"), "text")).languages(provider)
    paragraphs = files.paragraphs(files.office_runs(office))
    blocks = paragraphs.select(F.col("path").alias("doc_id"), F.struct("part", "para").alias("at"), "text", F.lit("line").alias("kind"))
    return told.unionByName(R.detect_languages(blocks, "at", provider)).withColumnRenamed("doc_id", "path")


#: Statuses of jobs whose output is there.
_DONE = ("translated", "copied_source_language")
#: Counters of segments, and their names in a job's JSON.
_COUNTERS = {"total": "segments_total", "translated": "segments_translated", "rejected": "segments_rejected", "calls": "api_calls"}
_OUTPUT = "path string, output_name string, content binary"


def _named(content: DataFrame, mark: str) -> DataFrame:
    return content.select("path", jobs.output_name(F.regexp_extract("path", "([^/]*)$", 1), F.lit(mark)).alias("output_name"), "content")


def _jobs(found: DataFrame, texts: DataFrame, judged: DataFrame | None, asked: DataFrame, source: str | None, provider: str, done: DataFrame | None) -> DataFrame:
    """The matrix of jobs with source_lang, status and the reason for what is not to be translated."""
    inputs = found.select(F.col("path").alias("doc_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("filename"))
    if source is None:
        told = file_languages(texts, found.where(T.suffix(F.col("path")).isin(".docx", ".pptx")), provider)
        inputs = inputs.join(told.withColumnRenamed("path", "__path"), F.col("doc_id") == F.col("__path"), "left").drop("__path")
    else:
        inputs = inputs.withColumn("source_lang", F.lit(source))
    matrix = jobs.job_matrix(inputs, asked, done)
    if judged is None:
        matrix = matrix.withColumn("refusal", F.lit(None).cast("string"))
    else:
        refused = lines.formula_policy(lines.pages(judged.select(F.col("path").alias("doc_id"), "text"))).where("not allowed").select(F.col("doc_id").alias("__path"), F.col("reason").alias("refusal"))
        matrix = matrix.join(refused, F.col("doc_id") == F.col("__path"), "left").drop("__path")
    open_ = F.col("status") == "pending"
    reason = F.when(open_ & F.col("refusal").isNotNull(), F.col("refusal")).when(open_ & F.col("source_lang").isNull(), "language_unknown")
    status = F.when(open_ & F.col("refusal").isNotNull(), "refused").when(open_ & F.col("source_lang").isNull(), "failed").otherwise(F.col("status"))
    return matrix.select(F.col("doc_id").alias("path"), "target_lang", "output_name", "source_lang", status.alias("status"), reason.alias("reason"))


def run(
    spark: SparkSession, source_dir: str, output_dir: str, targets: list[str], source: str | None, provider: str = "identity", batch_size: int = 50, overwrite: bool = False,
    extractors: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Translate the text and office files of a folder into each target language; returns manifest().

    Tables under output_dir are those of sources.runs: a folder for each target with the outputs (path, output_name, content), and
    `manifest` with one row for each input and target: status (translated, copied_source_language, skipped_existing, refused, failed),
    its reason, counters as JSON, quality flags and times. A run counts once all of it is written; one that dies has done nothing. With
    overwrite off, outputs of earlier runs are skipped. A file in the target language is copied; without a source language each file's
    own is detected, once for all targets, and where the provider cannot tell, the job has failed. So has one without an output.

    extractors give the texts (path, text) of files with other suffixes from (path, content). The formula policy is applied to these: the
    jobs of a document that it refuses have the status refused. Their outputs are texts.
    """
    asked = spark.createDataFrame([(t,) for t in targets], "code string")
    unknown = [r["code"] for r in jobs.unsupported_languages(asked).collect()]
    if unknown:
        raise ValueError(f"unsupported language codes: {', '.join(sorted(unknown))}")
    began, runs, others = time.time(), Runs(spark, output_dir), extractors or {}
    own = runs.new()
    found = files.read_files(spark, source_dir, (".txt", ".docx", ".pptx", *others))
    suffix = T.suffix(F.col("path"))
    texts = found.where(suffix == ".txt").select("path", files.decoded(F.col("content")).alias("text"))
    judged = None
    for name, extract in others.items():
        more = extract(found.where(suffix == name)).select("path", "text")
        judged = more if judged is None else judged.unionByName(more)
    if judged is not None:
        texts = texts.unionByName(judged)
    earlier = None if overwrite else runs.last("manifest", "output_name")
    done = None if earlier is None else earlier.where(F.col("status").isin(*_DONE, "skipped_existing")).select("output_name")
    matrix = runs.put(_jobs(found, texts, judged, asked, source, provider, done), "_jobs", own)
    counted = []
    for target in targets:
        mine = matrix.where(F.col("target_lang") == target)
        copied = found.join(mine.where("status = 'copied_source_language'").select("path"), "path").select("path", "content")
        open_ = mine.where("status = 'pending'").select("path", "source_lang")
        text = texts.join(open_, "path").select(F.col("path").alias("doc_id"), "source_lang", "text")
        said = Texts(text).translate(provider, None, target, batch_size).written(lambda rows, t=target: runs.put(rows, f"_segments-{t}", own))
        office = found.where(suffix.isin(".docx", ".pptx")).join(open_, "path").select("path", "content", "source_lang")
        kept: list[DataFrame] = []

        def keep(rows: DataFrame, t: str = target, kept: list[DataFrame] = kept) -> DataFrame:
            kept.append(runs.put(rows, f"_paragraphs-{t}", own))
            return kept[0]

        made = translate_office(office, provider, None, target, batch_size, keep)
        content = said.docs.select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")).unionByName(made).unionByName(copied)
        written = runs.put(_named(content, target), target, own)
        stats = said.stats().withColumnRenamed("doc_id", "path").unionByName(qa.segment_stats(kept[0], "path"))
        stats = stats.select("path", *[F.col(k).alias(v) for k, v in _COUNTERS.items()])
        counted.append(written.select("path").distinct().join(stats, "path", "left").withColumn("target_lang", F.lit(target)).withColumn("seconds", F.lit(time.time() - began)))
    whole = counted[0]
    for x in counted[1:]:
        whole = whole.unionByName(x)
    whole = whole.select(F.col("path").alias("__path"), F.col("target_lang").alias("__target"), F.when(F.col("api_calls").isNotNull(), qa.sidecar(whole.select(*_COUNTERS.values()), "segments")).alias("stats"), "seconds")
    both = matrix.join(whole, (F.col("path") == F.col("__path")) & (F.col("target_lang") == F.col("__target")), "left")
    open_, there = F.col("status") == "pending", F.col("__path").isNotNull()
    status = F.when(open_ & there, "translated").when(open_ | (F.col("status") == "copied_source_language") & ~there, "failed").otherwise(F.col("status"))
    reason = F.when(open_ & ~there, "no_output").otherwise(F.col("reason"))
    told = both.select(
        "path", "target_lang", "output_name", "source_lang", status.alias("status"), reason.alias("reason"), "stats", qa.quality_flags(F.col("stats")).alias("flags"),
        F.timestamp_seconds(F.lit(began)).alias("started"), F.when(there, T.duration(F.col("seconds"))).alias("took"),
    )
    runs.put(told, "manifest", own)
    runs.publish(own)
    return manifest(spark, output_dir)


def run_mapped(spark: SparkSession, source_dir: str, output_dir: str, mapping_path: str) -> DataFrame:
    """Text and HTML files of a folder with segments and text nodes replaced by a JSON mapping; returns manifest().

    Outputs go to the table `mapped`, published with its manifest as those of run().
    """
    began, runs = time.time(), Runs(spark, output_dir)
    own = runs.new()
    mapping = files.mapping(spark.read.text(mapping_path, wholetext=True), "value")
    found = files.read_files(spark, source_dir, (".txt", ".html", ".htm"))
    rows = found.select("path", files.decoded(F.col("content")).alias("text"))
    is_text = T.suffix(F.col("path")) == ".txt"
    texts = Texts(rows.where(is_text).select(F.col("path").alias("doc_id"), "text")).mapped(mapping)
    pages = Pages(rows.where(~is_text).select(F.col("path").alias("page_id"), F.col("text").alias("html"))).mapped(mapping)
    content = texts.docs.select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")).unionByName(pages.pages.select(F.col("page_id").alias("path"), F.encode("html", "UTF-8").alias("content")))
    written = runs.put(_named(content, "mapped"), "mapped", own)
    there = F.col("__path").isNotNull()
    told = found.select("path").join(written.select(F.col("path").alias("__path"), "output_name"), F.col("path") == F.col("__path"), "left").select(
        "path", F.lit(None).cast("string").alias("target_lang"), "output_name", F.lit(None).cast("string").alias("source_lang"), F.when(there, "translated").otherwise("failed").alias("status"),
        F.when(~there, "no_output").alias("reason"), F.lit(None).cast("string").alias("stats"), F.array().cast("array<string>").alias("flags"), F.timestamp_seconds(F.lit(began)).alias("started"), F.lit(None).cast("string").alias("took"),
    )
    runs.put(told, "manifest", own)
    runs.publish(own)
    return manifest(spark, output_dir)


def manifest(spark: SparkSession, output_dir: str) -> DataFrame:
    """What became of each output: the row of the last published run that did something about it."""
    runs = Runs(spark, output_dir)
    rows = runs.read("manifest")
    if rows is None:
        raise ValueError(f"no run has been published in {output_dir}")
    # A skipped job says nothing new of its output.
    rank = F.row_number().over(Window.partitionBy("output_name").orderBy(F.col("status") == "skipped_existing", F.desc("run")))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def outputs(spark: SparkSession, output_dir: str, target: str) -> DataFrame:
    """(path, output_name, content, run): each output of a target once, from the last published run that made it."""
    found = Runs(spark, output_dir).last(target, "output_name")
    return spark.createDataFrame([], f"{_OUTPUT}, run string") if found is None else found


def main(argv: list[str] | None = None) -> int:
    import argparse

    p = argparse.ArgumentParser(prog="folioform", description="Translate the documents of a folder.")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--target-lang", action="append", choices=sorted(fixed.LANGUAGES))
    what.add_argument("--mapping", help="a JSON object of texts and their replacements, for text and HTML files")
    p.add_argument("--source-lang", choices=sorted(fixed.LANGUAGES), help="detected where it is left out")
    p.add_argument("--provider", default="identity", help="one of " + ", ".join(sorted(R.PROVIDERS)) + ", or several in order, parted by '>'")
    p.add_argument("--batch-size", type=int, default=50)
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("folioform").getOrCreate()
    jobs_done = run_mapped(spark, a.input, a.output, a.mapping) if a.mapping else run(spark, a.input, a.output, a.target_lang, a.source_lang, a.provider, a.batch_size, a.overwrite)
    for row in jobs_done.groupBy("status").count().orderBy("status").collect():
        print(f"{row['status']}: {row['count']}")
    return 0
