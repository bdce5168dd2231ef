"""Requests and the matrix of translation jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def _blank_to_null(c: Column) -> Column:
    return F.nullif(T.strip(c), F.lit(""))


def _languages(target: Column, source: Column, engine: Column) -> Column:
    """Error code of the fields that all requests share, or null."""
    chosen, t, s = T.engine(engine), _blank_to_null(target), _blank_to_null(source)
    return (
        F.when(chosen.isNull(), "engine_unknown")
        .when(T.language_error(t).isNotNull(), F.concat(F.lit("target_"), T.language_error(t)))
        .when(T.language_error(s).isNotNull(), F.concat(F.lit("source_"), T.language_error(s)))
        .when(T.language_code(t) == T.language_code(s), "same_language")
        .when((chosen == "deepl") & t.isNotNull() & ~T.service_supports(t), "target_unsupported_by_service")
    )


def document_error(filename: Column, target: Column, source: Column, engine: Column) -> Column:
    return F.when(F.coalesce(filename, F.lit("")) == "", "file_missing").when(~T.suffix(filename).isin(*fixed.DOCUMENT_SUFFIXES), "suffix").when(_blank_to_null(target).isNull(), "target_missing").otherwise(_languages(target, source, engine))


def pdf_error(filename: Column, target: Column, source: Column, engine: Column, mapping: Column) -> Column:
    t, m = _blank_to_null(target), _blank_to_null(mapping)
    name = F.lower(F.coalesce(filename, F.lit("")))
    return F.when(~F.endswith(name, F.lit(".pdf")), "suffix").when(m.isNotNull() & t.isNotNull(), "mapping_and_target").when(m.isNull() & t.isNull(), "target_missing").otherwise(_languages(target, source, engine))


def cli_error(filename: Column, target: Column, layout: Column, mapping: Column, save_html: Column) -> Column:
    """Rules of the command line for flags that only one kind of input takes."""
    t, m, pdf = _blank_to_null(target), _blank_to_null(mapping), T.suffix(filename) == ".pdf"
    other = F.when(layout != "direct", "html_layout_needs_pdf").when(m.isNotNull(), "mapping_needs_pdf").when(save_html, "save_html_needs_pdf").when(t.isNull(), "target_missing")
    direct = F.when(m.isNotNull(), "mapping_needs_html_layout").when(save_html, "save_html_needs_html_layout").when(t.isNull(), "target_missing")
    html = F.when(m.isNotNull() & t.isNotNull(), "mapping_and_target").when(m.isNull() & t.isNull(), "target_missing")
    return F.when(~T.suffix(filename).isin(*fixed.DOCUMENT_SUFFIXES), "suffix").when(~pdf, other).when(layout == "direct", direct).otherwise(html)


def output_suffix(filename: Column) -> Column:
    s = F.regexp_extract(filename, r"^.+(\.[^./]+)$", 1)
    return F.when(F.lower(s) == ".doc", ".docx").when(F.lower(s) == ".ppt", ".pptx").otherwise(s)


def output_name(filename: Column, target: Column, mapping: Column | None = None) -> Column:
    mark = F.coalesce(target, F.when(mapping.isNotNull(), "mapped").otherwise("out") if mapping is not None else F.lit("out"))
    return F.concat(T.stem(filename), F.lit("_"), mark, output_suffix(filename))


def discover(paths: DataFrame, path: str = "path") -> DataFrame:
    """The paths of supported documents, in order."""
    return paths.where(T.suffix(F.col(path)).isin(*fixed.DOCUMENT_SUFFIXES)).orderBy(path)


def unsupported_languages(wanted: DataFrame) -> DataFrame:
    """The distinct codes asked for that are none of the languages."""
    known = wanted.sparkSession.createDataFrame([(k,) for k in fixed.LANGUAGES], "code string")
    return wanted.select(F.lower(T.strip(F.col("code"))).alias("code")).where("code <> ''").subtract(known)


def job_matrix(inputs: DataFrame, languages: DataFrame, done: DataFrame | None = None, copy_source: bool = True) -> DataFrame:
    """(doc_id, filename, source_lang, target_lang, output_name, status) for every input and language.

    Codes of no known language are left out, so the language table has a few dozen rows at most and is sent to every task. done
    (output_name) are outputs that exist: skipped_existing; the input's own language is copied; all else is pending.
    """
    known = languages.where(F.col("code").isin(*fixed.LANGUAGES)).select(F.col("code").alias("target_lang")).distinct()
    each = inputs.crossJoin(F.broadcast(known))
    each = each.withColumn("output_name", output_name(F.col("filename"), F.col("target_lang")))
    if done is not None:
        each = each.join(done.select(F.col("output_name").alias("__done")).distinct(), F.col("output_name") == F.col("__done"), "left")
    else:
        each = each.withColumn("__done", F.lit(None).cast("string"))
    own = F.lit(copy_source) & F.coalesce(F.col("source_lang") == F.col("target_lang"), F.lit(False))
    status = F.when(F.col("__done").isNotNull(), "skipped_existing").when(own, "copied_source_language").otherwise("pending")
    return each.withColumn("status", status).drop("__done")


def pending(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """Jobs without a finished one of the same name."""
    return jobs.join(finished.select("output_name"), "output_name", "left_anti")


def upsert(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("r"))
    return last.select(*keys, "r.*")
