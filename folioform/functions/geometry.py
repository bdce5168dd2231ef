"""Geometry of boxes on a page, as Column expressions. Boxes are structs with x0, y0, x1, y1; y grows downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared height over the smaller height; 0 if there is none."""
    shared = overlap(a["y0"], a["y1"], b["y0"], b["y1"])
    flat = (shared <= 0) | (height(a) <= 0) | (height(b) <= 0)
    return F.when(flat, 0.0).otherwise(shared / F.least(height(a), height(b)))


#: How far edges of boxes may be apart that are the same.
SAME = 0.5


def same(a: Column, b: Column, tolerance: float = SAME) -> Column:
    near = F.lit(True)
    for k in ("x0", "y0", "x1", "y1"):
        near = near & (F.abs(a[k] - b[k]) <= tolerance)
    return near


def colors_apart(a: Column, b: Column, delta: float = 0.20) -> Column:
    return F.greatest(*[F.abs(a[k] - b[k]) for k in ("r", "g", "b")]) > delta


def rgb(color: Column) -> Column:
    """struct<r, g, b> in 0 to 1 of a packed colour."""
    part = lambda n: F.shiftright(color, n).bitwiseAND(F.lit(255)) / 255.0
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def rotation(dx: Column, dy: Column) -> Column:
    return F.when(dx <= -0.92, 180).when(dy <= -0.92, 90).when(dy >= 0.92, 270).otherwise(0)


def is_wide(b: Column, page_width: Column) -> Column:
    return width(b) >= page_width * 0.6


def in_header_band(b: Column, page_width: Column) -> Column:
    return (b["y0"] < F.greatest(F.lit(120.0), page_width * 0.28)) & (width(b) >= page_width * 0.4)


def is_display(kind: Column, font_size: Column) -> Column:
    return (kind == "title") | (font_size >= 36)


def useful_image(b: Column) -> Column:
    return (width(b) >= 80) & (height(b) >= 50)


def from_thousandths(b: Column, image: Column) -> Column:
    """A box in thousandths of an image, in the coordinates of the image's box."""
    x = lambda v: image["x0"] + v / 1000.0 * width(image)
    y = lambda v: image["y0"] + v / 1000.0 * height(image)
    return F.struct(x(b["x0"]).alias("x0"), y(b["y0"]).alias("y0"), x(b["x1"]).alias("x1"), y(b["y1"]).alias("y1"))


def overlay(b: Column) -> Column:
    """Where an overlay for a page box goes, and its font size."""
    return F.struct(
        F.greatest(F.lit(0.0), b["x0"] - 2).alias("left"), F.greatest(F.lit(0.0), b["y0"] - 2).alias("top"), F.greatest(F.lit(36.0), width(b) * 1.18).alias("width"),
        F.greatest(F.lit(18.0), height(b) * 1.35).alias("height"), F.greatest(F.lit(10.0), F.least(F.lit(24.0), height(b) * 0.72)).alias("font_size"),
    )


def usable(b: Column) -> Column:
    return (width(b) >= 1) & (height(b) >= 1)


def degenerate(b: Column, text: Column) -> Column:
    return (width(b) < 3) | (height(b) < 3) | (F.trim(text) == "")


def growth(kind: Column, font_size: Column, line_count: Column, box_height: Column, column_index: Column, rotated: Column) -> Column:
    """struct<extra_width, height>: how far a box may grow for its translation."""
    fixed_box = rotated | is_display(kind, font_size)
    by_kind = lambda *v: F.when(kind == "abstract", v[0]).when(kind.isin("caption", "reference", "table"), v[1]).when(kind == "paragraph", v[2]).otherwise(v[3])
    lines = lambda least, start, each: F.greatest(F.lit(least), F.lit(start) + line_count * each)
    factor = by_kind(lines(2.8, 1.1, 1.1), lines(1.8, 0.95, 0.95), lines(2.4, 1.15, 1.02), lines(1.45, 0.9, 0.7))
    extra = F.least(by_kind(F.lit(20.0), F.lit(6.0), F.lit(14.0), F.lit(10.0)), F.greatest(F.lit(0.0), font_size * by_kind(F.lit(1.1), F.lit(0.25), F.lit(0.75), F.lit(0.5))))
    extra = F.when(fixed_box, 0.0).otherwise(extra)
    tall = F.when(fixed_box, box_height).otherwise(F.greatest(box_height, font_size * factor))
    in_column = column_index.isNotNull() & ~is_display(kind, font_size)
    return F.struct(F.when(in_column, F.least(extra, F.lit(6.0))).otherwise(extra).alias("extra_width"), F.when(in_column, tall * 1.18).otherwise(tall).alias("height"))


def start_size(kind: Column, font_size: Column) -> Column:
    """struct<size, line_height>: where the search for a fitting size begins."""
    clamp = lambda a, b: F.greatest(F.lit(a), F.least(font_size, F.lit(b)))
    size = F.when(is_display(kind, font_size), F.greatest(F.lit(8.0), font_size)).when(kind.isin("caption", "reference", "table"), clamp(6.0, 18.0)).otherwise(clamp(6.5, 28.0))
    line = F.when(kind == "title", 1.05).when(font_size >= 36, 1.08).when(kind.isin("caption", "reference", "table"), 1.06).when(kind.isin("paragraph", "abstract"), 1.18).otherwise(1.12)
    return F.struct(size.alias("size"), line.alias("line_height"))


def harmonize_key(kind: Column, column_index: Column, font_size: Column, rotated: Column) -> Column:
    """struct<column_index, kind_class, size> of blocks that share a size; null for rotated ones."""
    kind_class = F.when(kind.isin(*fixed.BODY_KINDS), "body").otherwise(kind)
    return F.when(~rotated, F.struct(column_index.alias("column_index"), kind_class.alias("kind_class"), F.bround(font_size).cast("int").alias("size")))


def inches(points: Column) -> Column:
    return points / 72.0


def page_scale(width_from: Column, height_from: Column, width_to: Column, height_to: Column) -> Column:
    return F.least(width_to / width_from, height_to / height_from)


def overflow_fit(text_width: Column, room: Column, font_size: Column) -> Column:
    """struct<size, squeeze, clipped> of text of a known width at font_size in a box of a known room.

    The size goes down by quarter pixels to 72 % or 8 while the text is too wide (width in proportion to size), then it is
    squeezed to 85 % at most; what is still wider is clipped.
    """
    least = F.greatest(F.lit(8.0), font_size * 0.72)
    most_steps = F.greatest(F.ceil((font_size - least) / 0.25), F.lit(0))
    needed = F.greatest(F.ceil((font_size - (room + 1) * font_size / text_width) / 0.25), F.lit(0))
    size = font_size - F.least(most_steps, needed) * 0.25
    now = text_width * size / font_size
    squeeze = F.when(now > room + 1, F.greatest(F.lit(0.85), room / now)).otherwise(1.0)
    return F.struct(size.alias("size"), squeeze.alias("squeeze"), (now * 0.85 > room + 1).alias("clipped"))
