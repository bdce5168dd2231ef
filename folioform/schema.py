"""Record types."""

from pyspark.sql import types as t

BOX = t.StructType([t.StructField(k, t.DoubleType()) for k in ("x0", "y0", "x1", "y1")])
COLOR = t.StructType([t.StructField(k, t.DoubleType()) for k in ("r", "g", "b")])
SPAN = t.StructType([t.StructField("text", t.StringType()), t.StructField("size", t.DoubleType()), t.StructField("font", t.StringType()), t.StructField("color", t.IntegerType())])
#: A line or block of text on a page; doc_id and page_index tell pages apart, line_id gives the order in which lines were read.
LINE = t.StructType(
    [
        t.StructField("doc_id", t.LongType()),
        t.StructField("page_index", t.IntegerType()),
        t.StructField("line_id", t.IntegerType()),
        *BOX.fields,
        t.StructField("text", t.StringType()),
        t.StructField("font_name", t.StringType()),
        t.StructField("font_size", t.DoubleType()),
        *COLOR.fields,
        t.StructField("raw_block_id", t.IntegerType()),
        t.StructField("rotation", t.IntegerType()),
        t.StructField("page_width", t.DoubleType()),
        t.StructField("confidence", t.DoubleType()),
    ]
)
#: What an adapter for page files brings besides lines: the page's size in points, its links, its raw blocks. A raw block's type is
#: TEXT_BLOCK for text; others (images) have no lines.
PAGE = t.StructType([t.StructField("doc_id", t.LongType()), t.StructField("page_index", t.IntegerType()), t.StructField("width", t.DoubleType()), t.StructField("height", t.DoubleType())])
LINK = t.StructType([t.StructField("doc_id", t.LongType()), t.StructField("page_index", t.IntegerType()), *BOX.fields, t.StructField("kind", t.IntegerType()), t.StructField("uri", t.StringType()), t.StructField("target", t.LongType())])
RAW_BLOCK = t.StructType([t.StructField("doc_id", t.LongType()), t.StructField("page_index", t.IntegerType()), t.StructField("raw_block_id", t.IntegerType()), t.StructField("block_type", t.IntegerType()), *BOX.fields])
TEXT_BLOCK = 0
#: A paragraph run of an office document.
RUN = t.StructType([t.StructField("path", t.StringType()), t.StructField("part", t.StringType()), t.StructField("para", t.IntegerType()), t.StructField("run", t.IntegerType()), t.StructField("text", t.StringType())])
#: A text node of a page.
NODE = t.StructType(
    [
        t.StructField("page_id", t.LongType()),
        t.StructField("node_id", t.IntegerType()),
        t.StructField("tag", t.StringType()),
        t.StructField("prefix_ws", t.StringType()),
        t.StructField("core", t.StringType()),
        t.StructField("suffix_ws", t.StringType()),
    ]
)
