"""Text functions as Column expressions.

Patterns use explicit character classes, so that they mean the same in Java and in RE2, whatever the engine's idea of \\s, \\d and \\b.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Characters that count as white space.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LETTER = r"\p{L}"
#: Decimal digits, superscripts and subscripts.
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
UPPER = r"\p{Lu}"
#: A character of a word, and one that ends it.
WORD, NOT_WORD = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
#: Ends of lines, the two-character one first.
LINE_END = r"\r\n|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
BULLET = r"^" + SPACE + r"*[-•▪◦‣·*]" + SPACE


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once a row, also where the optimizer would put its expression in each place it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: The same characters one by one.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    # Most texts need neither replacement, which two quick looks show.
    spaced = lambda t: F.when(t.rlike(r"[^\x{20}-\x{7e}]"), F.translate(t, SPACES, " " * len(SPACES))).otherwise(t)
    single = lambda t: F.trim(F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t))
    return let(let(c, spaced), single)


def comparable(c: Column) -> Column:
    return F.lower(collapse(c))


def one_line(c: Column) -> Column:
    """Line breaks with the white space around them as one space, none at the ends."""
    return strip(F.regexp_replace(c, f"{SPACE}*\n+{SPACE}*", " "))


def times(c: Column, pattern: str) -> Column:
    """Number of characters that match the one-character pattern."""
    without = F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    return F.when(c.rlike(pattern), without).when(c.isNotNull(), 0)


def letters(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, f"{LETTER}+", ""))  # a word at once


def digits(c: Column) -> Column:
    return times(c, f"(?![ -/:-~]){DIGIT}")  # what most characters are is told apart first


def words(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Runs of word characters."""
    return F.filter(F.split(c, f"{NOT_WORD}+"), lambda w: w != "")


def join_hyphened(before: Column, after: Column) -> Column:
    """Two pieces of running text as one: a hyphen at the break goes, else a space comes in."""
    a, b = rstrip(before), lstrip(after)
    return F.when(a == "", b).when(b == "", a).when(F.endswith(a, F.lit("-")), F.concat(F.left(a, F.length(a) - 1), b)).otherwise(F.concat(a, F.lit(" "), b))


def is_bullet(c: Column) -> Column:
    return c.rlike(BULLET)


def without_bullet(c: Column) -> Column:
    return F.regexp_replace(c, BULLET, "")


def outer_space(c: Column) -> tuple[Column, Column, Column]:
    """(white space before, core, white space after); of blank text all is before."""
    before = F.regexp_extract(c, f"^({SPACE}*)", 1)
    core = strip(c)
    return before, core, F.when(core == "", "").otherwise(F.regexp_extract(c, f"({SPACE}*)$", 1))


def rewrap(original: Column, core: Column) -> Column:
    """core with the white space that stands around original."""
    before, _, after = outer_space(original)
    return F.concat(before, core, after)


def replace_core(original: Column, new: Column) -> Column:
    """original with every occurrence of its own stripped text replaced."""
    return F.replace(original, strip(original), new)


def sanitized(c: Column) -> Column:
    """Symbols as those that fonts have."""
    return F.translate(c, "".join(fixed.SYMBOLS), "".join(fixed.SYMBOLS.values()))


def language_code(c: Column) -> Column:
    code = F.replace(F.lower(strip(c)), F.lit("_"), F.lit("-"))
    return F.when(code.rlike(r"^(?s:..-..)$"), F.left(code, F.lit(2))).otherwise(code)


def language_error(c: Column) -> Column:
    """'format', 'unknown', or null for a null or supported code."""
    code = language_code(c)
    return F.when(c.isNull(), None).when(~code.rlike(r"^\p{L}\p{L}$"), "format").when(~code.isin(*fixed.LANGUAGES), "unknown")


def detected_code(c: Column) -> Column:
    """The first free-standing two-letter word, if it is a supported code; else null."""
    code = F.regexp_extract(language_code(c), f"(?:^|{NOT_WORD})([a-z][a-z])(?:$|{NOT_WORD})", 1)
    return F.when(code.isin(*fixed.LANGUAGES), code)


def metadata_language(*fields: Column) -> Column:
    """Of fields by priority, the first free-standing two-letter code, with or without a region."""
    found = [F.nullif(F.lower(F.regexp_extract(f, f"(?i:(?:^|{NOT_WORD})([a-z][a-z])(?:[-_][a-z][a-z])?(?:$|{NOT_WORD}))", 1)), F.lit("")) for f in fields]
    return F.coalesce(*found)


def engine(c: Column, default: str = "llm") -> Column:
    """The engine named, the default for a blank, null for an unknown one."""
    name = F.lower(strip(c))
    return F.when(c.isNull() | (name == ""), default).when(name.isin(*fixed.ENGINES), name)


def service_supports(c: Column) -> Column:
    code = language_code(c)
    return code.isin(*fixed.LANGUAGES) & ~code.isin(*fixed.SERVICE_LACKS)


def service_target(c: Column, english: str = "EN-GB", portuguese: str = "PT-PT") -> Column:
    """The service's code for a target language, null for one it lacks."""
    code = language_code(c)
    return F.when(~service_supports(c), None).when(code == "en", english).when(code == "pt", portuguese).otherwise(F.upper(code))


def first_set(*values: Column) -> Column:
    """The first value that is not blank, stripped."""
    return F.coalesce(*[F.nullif(strip(v), F.lit("")) for v in values])


def stem(name: Column) -> Column:
    """The file name without its last suffix."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_extract(base, r"^(.+)\.[^.]+$", 1)).otherwise(base)


def suffix(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))


def safe_stem(name: Column) -> Column:
    own = F.when(stem(name) == "", "document").otherwise(stem(name))
    safe = F.left(F.regexp_replace(own, r"[^\p{L}\p{N}_-]", "_"), F.lit(120))
    return F.when(safe == "", "document").otherwise(safe)


def media_type(name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in fixed.MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(kinds, suffix(name)), F.lit("application/octet-stream"))


def base_url(c: Column) -> Column:
    """The address with one /v1 at its end; blank stays blank."""
    url = strip(c)
    bare = F.regexp_replace(url, "/+$", "")
    return F.when((url == "") | F.endswith(bare, F.lit("/v1")), url).otherwise(F.concat(bare, F.lit("/v1")))


# Marks of bold and of slanted faces in font names, anywhere or at the end, and the base fonts plain, bold, slanted, both.
BOLD_MARKS, SLANT_MARKS = "bold|bd$", "italic|oblique|it$"
BASE_FONTS = ("helv", "hebo", "heit", "hebi")


def base_font(name: Column) -> Column:
    """The base font of the same weight and slant."""
    style = F.lower(name).rlike(BOLD_MARKS).cast("int") + 2 * F.lower(name).rlike(SLANT_MARKS).cast("int")
    return F.get(F.array(*map(F.lit, BASE_FONTS)), style)


# The patterns of a reply's parts.
FENCED_JSON = r"(?s)```(?:json)?[ \t\r\n]*(\{.*?\})[ \t\r\n]*```"
PAIRS = r'"(\d+)"[ \t\r\n]*:[ \t\r\n]*"([^"]*(?:\\"[^"]*)*)"'


def reply_map(c: Column) -> Column:
    """map<string,string> of a model's reply: fenced or bare JSON, else what pairs can be recovered from it."""
    content = strip(c)
    fenced = F.regexp_extract(content, FENCED_JSON, 1)
    body = F.when(fenced != "", fenced).otherwise(content)
    strict = F.try_variant_get(F.try_parse_json(body), "$", "map<string,string>")
    keys = F.regexp_extract_all(body, F.lit(PAIRS), F.lit(1))
    values = F.transform(F.regexp_extract_all(body, F.lit(PAIRS), F.lit(2)), lambda v: F.replace(v, F.lit('\\"'), F.lit('"')))
    return F.coalesce(strict, F.map_from_arrays(keys, values))


def unfenced(c: Column) -> Column:
    """A plain reply without the fence around it; null if nothing is left."""
    content = strip(c)
    inner = F.regexp_extract(content, r"(?s)```(?:text)?[ \t\r\n]*(.*?)[ \t\r\n]*```", 1)
    return F.nullif(F.when(content.rlike(r"(?s)```(?:text)?[ \t\r\n]*.*?[ \t\r\n]*```"), strip(inner)).otherwise(content), F.lit(""))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def data_url(content: Column, name: Column) -> Column:
    """The content as a URL of its own, of the type that the file name shows, an image if it shows none."""
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in fixed.IMAGE_TYPES.items() for x in kv]), suffix(name)), F.lit("image/png"))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def excerpt(c: Column, length: int) -> Column:
    """At most so many characters, with a mark where more follow."""
    return F.concat(F.left(c, F.lit(length)), F.when(F.length(c) > length, "…").otherwise(""))


def listed_samples(samples: Column, most: int = 10, length: int = 280) -> Column:
    """The first samples that are not blank, cut short, one a line; what a model is asked about a language."""
    some = F.slice(F.filter(samples, lambda s: strip(s) != ""), 1, most)
    return F.array_join(F.transform(some, lambda s: F.concat(F.lit("- "), F.left(s, F.lit(length)))), "\n")


def first_sample(samples: Column, length: int = 200) -> Column:
    """The beginning of the first sample that is not blank, null without one; what a service is asked about a language."""
    return F.left(F.get(F.filter(F.transform(samples, strip), lambda s: s != ""), F.lit(0)), F.lit(length))


def css_pixels(style: Column, name: str) -> Column:
    """Width or height in pixels from a style attribute, 0 without one."""
    return F.coalesce(F.regexp_extract(style, name + r":[ \t\r\n]*([0-9.]+)px", 1).try_cast("double"), F.lit(0.0))


def duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    tenths = lambda s: F.format_string("%.1fs", F.bround(s, 1))
    rest = tenths(seconds - minutes * 60)
    short = F.concat(minutes.cast("string"), F.lit("m "), rest)
    return F.when(seconds < 60, tenths(seconds)).when(minutes < 60, short).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m "), rest))


def expansion_ratio(code: Column) -> Column:
    ratios = F.create_map(*[F.lit(x) for kv in fixed.EXPANSION.items() for x in kv])
    return F.coalesce(F.element_at(ratios, language_code(code)), F.lit(fixed.DEFAULT_EXPANSION))


def area_scale(code: Column) -> Column:
    """Font scale at which a translation needs the area of its source."""
    return F.least(F.lit(1.0), 1.0 / F.sqrt(expansion_ratio(code)))


def needs_unicode_font(c: Column) -> Column:
    return c.rlike(r"[^\x{0}-\x{ff}]|•")


def prompt(source: Column, target: Column, text: Column) -> Column:
    return F.concat(F.lit("Translate from "), source, F.lit(" to "), target, F.lit(". Return only the translation:\n\n"), text)


def batch_prompt(source: Column, target: Column, ids: Column, texts: Column) -> Column:
    """A prompt of numbered JSON strings to translate one by one."""
    quoted = F.zip_with(ids, texts, lambda i, t: F.concat(F.lit('"'), i.cast("string"), F.lit('": '), F.to_json(F.array(t)).substr(F.lit(2), F.length(F.to_json(F.array(t))) - 2)))
    return F.concat(F.lit("Translate from "), source, F.lit(" to "), target, F.lit(". Reply with JSON only.\n\n{\n  "), F.array_join(quoted, ",\n  "), F.lit("\n}"))
