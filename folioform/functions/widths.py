"""Widths of texts by a font's advances, and lines broken between words."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

# The characters of each advance, in thousandths of an em, of the two weights of the usual base font.
REGULAR = {
    191: "'", 222: "ijl", 260: "|", 278: " !,./:;I[\\]ft", 333: "()-`r", 334: "{}", 355: '"', 389: "*", 469: "^", 500: "Jcksvxyz", 556: "#$0123456789?L_abdeghnopqu",
    584: "+<=>~", 611: "FTZ", 667: "&ABEKPSVXY", 722: "CDHNRUw", 778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1015: "@",
}
BOLD = {
    238: "'", 278: " ,./I\\ijl", 280: "|", 333: "!()-:;[]`ft", 389: "*r{}", 474: '"', 500: "z", 556: "#$0123456789J_aceksvxy", 584: "+<=>^~", 611: "?FLTZbdghnopqu",
    667: "EPSVXY", 722: "&ABCDHKNRU", 778: "GOQw", 833: "M", 889: "%m", 944: "W", 975: "@",
}

#: Thousandths of an em of a character that a table of advances lacks.
UNKNOWN = 500
#: Glyphs of all fonts of a table of advances, at most: it becomes part of the plan.
MOST_GLYPHS = 1 << 20


def base_advances(spark: SparkSession) -> DataFrame:
    """(font, code, advance) of the base fonts: letters with marks are as wide as without, slanted letters as upright ones."""
    rows = []
    for fonts, table in ((("helv", "heit"), REGULAR), (("hebo", "hebi"), BOLD)):
        plain = {c: width for width, chars in table.items() for c in chars}
        wide = {c: plain[own] for c in map(chr, range(0x20, 0x180)) if (own := unicodedata.normalize("NFD", c)[0]) in plain}
        wide.update({c: plain[" "] for c in wide if c not in plain and unicodedata.normalize("NFD", c)[0] == "i"} | {" ": plain[" "]})  # an i without its dot
        rows += [(font, ord(c), width) for font in fonts for c, width in wide.items()]
    told = F.from_json(F.lit(json.dumps([{"font": f, "code": c, "advance": w} for f, c, w in rows])), "array<struct<font:string,code:int,advance:int>>")
    return spark.range(1).select(F.inline(told))


def advances_by_code(advances: DataFrame) -> dict[str, list[int]]:
    """Advances of each font of a table (font, code, advance) by code point, UNKNOWN where it has none; of repeated codes, the widest.

    Rows with a null, a negative code or a negative advance are left out.
    """
    good = advances.where((F.col("code") >= 0) & (F.col("advance") >= 0) & F.col("font").isNotNull()).groupBy("font", "code").agg(F.max("advance").alias("advance"))
    found = good.limit(MOST_GLYPHS + 1).collect()
    if len(found) > MOST_GLYPHS:
        raise ValueError(f"advances of more than {MOST_GLYPHS} glyphs")
    fonts: dict[str, list[int]] = {}
    for font, code, advance in sorted(found):
        own = fonts.setdefault(font, [])
        own.extend([UNKNOWN] * (code - len(own)))
        own.append(advance)
    return fonts


def _literal(values: list[int]) -> Column:
    """One array literal, so that a character is looked up by its place and rows do not carry the table."""
    return F.split(F.lit(",".join(map(str, values or [UNKNOWN]))), ",").cast("array<int>")


class Metrics:
    """Widths of texts in thousandths of an em as Column expressions."""

    def __init__(self, advances: DataFrame):
        self.fonts = advances_by_code(advances)

    def glyphs(self, font: Column, text: Column) -> Column:
        """array<int>: the advance of each code point of a text; null for a null text."""
        codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)

        def advances(values: list[int]) -> Column:
            return F.transform(codes, lambda c: F.coalesce(F.get(_literal(values), c), F.lit(UNKNOWN)))

        found = advances([])
        for name, values in self.fonts.items():
            found = F.when(font == name, advances(values)).otherwise(found)
        return found

    def paragraphs(self, font: Column, text: Column) -> Column:
        """array<array<struct<width, glyphs>>>: the words of each line as written, with the advances of their code points.

        Words are parted by single spaces.
        """
        lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
        known = lambda g: F.struct(F.aggregate(g, F.lit(0), lambda s, a: s + a).alias("width"), g.alias("glyphs"))
        return F.transform(lines, lambda l: F.transform(F.transform(F.split(l, " "), lambda w: self.glyphs(font, w)), known))

    def space(self, font: Column) -> Column:
        """The advance of a space."""
        found = F.lit(UNKNOWN)
        for name, values in self.fonts.items():
            found = F.when(font == name, F.lit(values[32] if len(values) > 32 else UNKNOWN)).otherwise(found)
        return found


def total(paragraphs: Column) -> Column:
    """The widths of all words of Metrics.paragraphs, without spaces."""
    return F.aggregate(F.flatten(paragraphs), F.lit(0).cast("long"), lambda s, w: s + w["width"])


def widest(paragraphs: Column) -> Column:
    """The widest glyph of Metrics.paragraphs, 0 of none."""
    return F.aggregate(F.flatten(paragraphs), F.lit(0), lambda m, w: F.greatest(m, F.coalesce(F.array_max(w["glyphs"]), F.lit(0))))


def wrapped(paragraphs: Column, space: Column, room: Column) -> Column:
    """Lines that Metrics.paragraphs take in a room as wide as `room` thousandths of an em.

    Words fill a line while they fit, a space before each but the first; one that is wider than a whole line begins on a line of its
    own and is broken between code points, one at least to a line. A line as written without a word is a line. Null for null.
    """
    at = lambda n, x: F.struct(n.cast("int").alias("n"), x.cast("int").alias("x"), F.lit(False).alias("first"))

    def glyph(a: Column, g: Column) -> Column:
        return F.when((a["x"] > 0) & (a["x"] + g > room), at(a["n"] + 1, g)).otherwise(at(a["n"], a["x"] + g))

    def word(a: Column, w: Column) -> Column:
        width = w["width"]
        broken = F.aggregate(w["glyphs"], at(a["n"] + F.when(a["first"], 0).otherwise(1), F.lit(0)), glyph)
        behind = a["x"] + space + width
        joined = F.when(~a["first"] & (behind <= room), at(a["n"], behind)).when(width <= room, at(a["n"] + F.when(a["first"], 0).otherwise(1), width))
        return joined.otherwise(broken)

    def line(n: Column, words: Column) -> Column:
        start = F.struct(F.lit(1).alias("n"), F.lit(0).alias("x"), F.lit(True).alias("first"))
        return n + F.aggregate(words, start, word, lambda a: a["n"])

    return F.aggregate(paragraphs, F.lit(0), line)
