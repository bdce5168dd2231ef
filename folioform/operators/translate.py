"""Translation of segments and blocks as a dataflow, and what is left over.

Rows go through five steps without a branch: a provider is asked for a call's rows at a time, its replies are judged by Column rules,
what is suspicious is asked for once more by itself, judged again, and the better of reply and source is chosen. Providers stand in
an order; which of them a call goes to follows from a table of what each kind of failure means.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import partial
from typing import Protocol
from urllib.parse import parse_qsl

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..functions.fixed import STOPWORDS
from .lines import detection_samples

#: Rows of one call at most, whatever a provider would take.
MOST_ROWS = 40


class Unavailable(Exception):
    """The provider is down: quota, connection, credentials."""


class UnsupportedLanguage(Exception):
    """The provider lacks the language; it stays usable for others."""


#: What a failure means: True if the provider is not asked again for the same document, False if only this call goes to the next.
FAILURES: dict[type[Exception], bool] = {Unavailable: True, OSError: True, UnsupportedLanguage: False}


class Provider(Protocol):
    """Where translations come from; one is made for a partition when it is first needed there."""

    def translate(self, texts: list[str], source: str, target: str) -> list[str | None]:
        """A reply to each text, or None."""

    def detect(self, samples: list[str]) -> str | None:
        """The language code of the samples, None if they do not tell."""


class Identity:
    """Gives every text back. Its samples are English if they hold as many function words as English does."""

    def translate(self, texts: list[str], source: str, target: str) -> list[str | None]:
        return list(texts)

    def detect(self, samples: list[str]) -> str | None:
        found = re.findall("[a-z']+", " ".join(samples).lower())
        return "en" if found and sum(w in STOPWORDS for w in found) >= 0.22 * len(found) else None


class Marking(Identity):
    """Deterministic stand-in for a translation: reverses each word."""

    def translate(self, texts: list[str], source: str, target: str) -> list[str | None]:
        return [" ".join(w[::-1] for w in t.split()) or None for t in texts]


class Cipher(Identity):
    """Deterministic stand-in whose replies share few letters with their source: each Latin letter goes 13 places on."""

    def translate(self, texts: list[str], source: str, target: str) -> list[str | None]:
        return [codecs.encode(t, "rot13") for t in texts]


class Dictionary(Identity):
    """Looks whole texts up."""

    def __init__(self, entries: dict[str, str]):
        self.entries = entries

    def translate(self, texts: list[str], source: str, target: str) -> list[str | None]:
        return [self.entries.get(t.strip()) for t in texts]


#: Makers of providers by name.
PROVIDERS: dict[str, Callable[..., Provider]] = {"identity": Identity, "marking": Marking, "cipher": Cipher}


def makers(names: str) -> list[Callable[[], Provider]]:
    """Makers for names parted by '>': each is asked where those before it fail.

    A name may be followed by options for its maker, as in "reader?prompt=Read+this&max_tokens=512"; their values are strings.
    """
    found = []
    for wanted in names.split(">"):
        name, _, options = wanted.strip().partition("?")
        if name not in PROVIDERS:
            raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(PROVIDERS))}")
        found.append(partial(PROVIDERS[name], **dict(parse_qsl(options, strict_parsing=bool(options)))))
    return found


class Desk:
    """Sends calls to the first provider that may serve them; makes providers as they are needed."""

    def __init__(self, chain: list[Callable[[], Provider]]):
        self.chain = chain
        self.made: dict[int, Provider] = {}
        self.document: object = None
        self.closed: set[int] = set()

    def call(self, document: object, method: str, *args):
        """(result, number of the provider that gave it). The last provider's failure is the caller's."""
        if document != self.document:
            self.document, self.closed = document, set()
        serving = [k for k in range(len(self.chain)) if k not in self.closed] or [len(self.chain) - 1]
        for k in serving:
            try:
                if k not in self.made:
                    self.made[k] = self.chain[k]()
                return getattr(self.made[k], method)(*args), k
            except tuple(FAILURES) as e:
                if k == serving[-1]:
                    raise
                if next(lasting for kind, lasting in FAILURES.items() if isinstance(e, kind)):
                    self.closed.add(k)


def ask(rows: DataFrame, key: str, order: str, text: str, call: str, names: str, reply: str) -> DataFrame:
    """Adds reply and its number of calls, `reply`_calls (1 at a call's first row), to rows; columns source_lang and target_lang say
    what is asked.

    A key's rows with the same number in `call` go in one call; a negative number is not asked. A key's rows must be in one
    partition, as they are after a window over the key.
    """
    chain = makers(names)

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        desk, held = Desk(chain), None

        def answered(pdf: pd.DataFrame) -> pd.DataFrame:
            out, calls = [None] * len(pdf), [0] * len(pdf)
            at = 0
            numbers, keys, texts = pdf[call].tolist(), pdf[key].tolist(), pdf[text].tolist()
            langs = list(zip(pdf["source_lang"], pdf["target_lang"]))
            while at < len(pdf):
                end = at + 1
                while end < len(pdf) and numbers[end] == numbers[at] and keys[end] == keys[at]:
                    end += 1
                if numbers[at] >= 0:
                    out[at:end], _ = desk.call(keys[at], "translate", texts[at:end], *langs[at])
                    calls[at] = 1
                at = end
            return pdf.assign(**{reply: out, f"{reply}_calls": calls})

        for pdf in batches:
            pdf = pd.concat([held, pdf], ignore_index=True) if held is not None and len(held) else pdf
            same = (pdf[key] == pdf[key].iloc[-1]) & (pdf[call] == pdf[call].iloc[-1])  # the last call may go on in the next batch
            held = pdf[same]
            if (~same).any():
                yield answered(pdf[~same].reset_index(drop=True))
        if held is not None and len(held):
            yield answered(held.reset_index(drop=True))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.sortWithinPartitions(key, call, order).mapInPandas(serve, f"{schema}, `{reply}` string, `{reply}_calls` int")


#: A reply leaks its source if a stretch of this share of it, and so many characters at least, stays, or if both are that much alike.
LEAK_SHARE, LEAK_CHARS, LEAK_RATIO = 0.45, 28, 0.82


def overlap(src: Column, dst: Column) -> Column:
    """struct<longest int, ratio double> of two texts: their longest common stretch, and how alike they are if more than LEAK_RATIO."""

    @F.pandas_udf("struct<longest:int,ratio:double>")
    def measure(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = []
        for x, y in zip(a, b):
            longest, ratio = 0, 0.0
            if x and y:
                m = SequenceMatcher(None, x, y)
                longest = m.find_longest_match().size
                if min(m.real_quick_ratio(), m.quick_ratio()) > LEAK_RATIO:  # both are upper bounds
                    ratio = m.ratio()
            found.append((longest, ratio))
        return pd.DataFrame(found, columns=["longest", "ratio"])

    return measure(src, dst)


def shared_at_most(a: Column, b: Column) -> Column:
    """How many characters two texts have in common at most, wherever they stand: no common stretch is longer, no matching has more."""

    def both(x: Column) -> Column:
        a, b = x["a"], x["b"]
        held = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
        common = F.array_intersect(F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, "")))
        return F.aggregate(F.filter(common, lambda c: c != ""), F.lit(0), lambda n, c: n + F.least(held(a, c), held(b, c)))

    return T.let(F.struct(a.alias("a"), b.alias("b")), both)


def suspicious(rows: DataFrame, source: str = "source_lang", target: str = "target_lang", src: str = "src", dst: str = "dst", out: str = "suspicious") -> DataFrame:
    """Adds a boolean to rows: the translation is empty, the source itself, degenerate, leaks the source or stays English.

    Only rows that no other rule decides, whose source is long enough, and which have as many characters in common as a leak needs, reach
    Python for the measure of what they share in order.
    """
    a, b = T.comparable(F.col(src)), T.comparable(F.coalesce(dst, F.lit("")))
    rows = rows.withColumn("__a", a).withColumn("__b", b)
    a, b = F.col("__a"), F.col("__b")
    clear = (b == "") | (a == b) | P.degenerate(a, b) | ((F.col(source) == "en") & (F.col(target) != "en") & P.english_left(b))
    rows = rows.withColumn("__clear", F.when(F.col(source) == F.col(target), False).when(clear, True).when(F.length(a) < 40, False))
    least = F.greatest(F.lit(LEAK_CHARS), F.floor(F.length(a) * LEAK_SHARE))
    enough = lambda n: (n >= least) | (2 * n / (F.length(a) + F.length(b)) > LEAK_RATIO)
    rows = rows.withColumn("__clear", F.when(F.col("__clear").isNull() & ~T.let(shared_at_most(a, b), enough), False).otherwise(F.col("__clear")))
    rows = rows.withColumn("__shared", overlap(F.when(F.col("__clear").isNull(), a), F.when(F.col("__clear").isNull(), b)))
    leak = (F.col("__shared.longest") >= least) | (F.col("__shared.ratio") > LEAK_RATIO)
    return rows.withColumn(out, F.coalesce("__clear", leak)).drop("__a", "__b", "__clear", "__shared")


def translate_batches(rows: DataFrame, key: str, order: str, names: str, source: str | None, target: str, batch_size: int = 50) -> DataFrame:
    """(key, order, text, final_text, state, calls, retried) of rows (key, order, text), asked for in calls of a key's rows.

    With source None the rows bring source_lang. state is blank, translated, rejected or (where the source language is the target or
    unknown) skipped; then the text stays. calls counts a call at its first row, and one more for a row that was tried again.
    """
    lang = F.col("source_lang") if source is None else F.lit(source)
    rows = rows.select(key, order, "text", lang.alias("source_lang"), F.lit(target).alias("target_lang"))
    asked = F.coalesce((T.strip(F.col("text")) != "") & (F.col("source_lang") != F.col("target_lang")), F.lit(False))
    at = F.sum(asked.cast("int")).over(Window.partitionBy(key).orderBy(order)) - 1
    size = max(1, min(batch_size, MOST_ROWS))
    rows = rows.withColumn("__at", at).withColumn("__call", F.when(asked, F.floor(F.col("__at") / size)).otherwise(-1))
    once = suspicious(ask(rows, key, order, "text", "__call", names, "__first"), src="text", dst="__first", out="__doubtful")
    once = once.withColumn("__call", F.when((F.col("__first") != "") & F.col("__doubtful"), F.col("__at")).otherwise(-1))
    twice = suspicious(ask(once, key, order, "text", "__call", names, "__second"), src="text", dst="__second", out="__refused")
    usable = lambda reply, bad: F.when((F.col(reply) != "") & ~F.col(bad), F.col(reply))
    best = F.coalesce(usable("__first", "__doubtful"), F.when(F.col("__call") >= 0, usable("__second", "__refused")))
    blank = F.coalesce(T.strip(F.col("text")) == "", F.lit(True))
    state = F.when(blank, "blank").when(F.coalesce(F.col("source_lang") == F.col("target_lang"), F.lit(True)), "skipped").when(best.isNotNull(), "translated").otherwise("rejected")
    calls = (F.col("__first_calls") + F.col("__second_calls")).alias("calls")
    return twice.select(key, order, "text", F.when(state == "translated", best).otherwise(F.col("text")).alias("final_text"), state.alias("state"), calls, (F.col("__call") >= 0).alias("retried"))


def detect_languages(blocks: DataFrame, order: str, names: str) -> DataFrame:
    """(doc_id, source_lang) of every document of blocks (doc_id, text, kind): the provider's word on its samples, null if it has none.

    A document without any sample counts as English.
    """
    samples = detection_samples(blocks, order).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x["chunk"]).alias("samples"))
    chain, kind = makers(names), dict(blocks.dtypes)["doc_id"]

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        desk = Desk(chain)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source_lang": [desk.call(k, "detect", list(s))[0] for k, s in zip(pdf["doc_id"], pdf["samples"])]})

    told = samples.mapInPandas(serve, f"doc_id {kind}, source_lang string").select(F.col("doc_id").alias("__id"), F.struct(T.detected_code(F.col("source_lang")).alias("code")).alias("told"))
    all_ = blocks.select("doc_id").distinct().join(told, F.col("doc_id") == F.col("__id"), "left")
    return all_.select("doc_id", F.when(F.col("told").isNull(), "en").otherwise(F.col("told.code")).alias("source_lang"))


def apply_replies(rows: DataFrame, replies: DataFrame, on: list[str]) -> DataFrame:
    """Adds final_text: the reply (on, reply), or the row's text where there is none or an empty one."""
    r = replies.select(*[F.col(k).alias(f"__{k}") for k in on], F.col("reply").alias("__reply"))
    match = F.lit(True)
    for k in on:
        match = match & (F.col(k) == F.col(f"__{k}"))
    return rows.join(r, match, "left").withColumn("final_text", F.coalesce(F.nullif(F.col("__reply"), F.lit("")), F.col("text"))).drop("__reply", *[f"__{k}" for k in on])


def replace_mapped(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds new_text and replaced to rows (text): where the stripped text is in the mapping (key, value), its value in the same white space."""
    m = mapping.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    joined = nodes.withColumn("__core", T.strip(F.col("text"))).join(m, (F.col("__core") == F.col("__key")) & (F.col("__core") != ""), "left")
    hit = F.col("__key").isNotNull()
    return joined.withColumn("new_text", F.when(hit, F.replace(F.col("text"), F.col("__core"), F.col("__value"))).otherwise(F.col("text"))).withColumn("replaced", hit).drop("__core", "__key", "__value")


def route(calls: DataFrame, key: str, order: str, failed: Column, unsupported: Column) -> DataFrame:
    """Adds route to ordered calls: 'first', 'fallback' for this call alone, or 'down' after a key's first service failure."""
    since = calls.where(failed).groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__since"))
    down = F.coalesce(F.col(order) > F.col("__since"), F.lit(False))
    joined = calls.join(since, F.col(key) == F.col("__key"), "left")
    return joined.withColumn("route", F.when(down, "down").when(failed | unsupported, "fallback").otherwise("first")).drop("__key", "__since")


def residual_blocks(blocks: DataFrame, placed: DataFrame, on: list[str], samples: int = 5, length: int = 80) -> DataFrame:
    """(doc_id, residual, samples) of translatable blocks (masked, text, kind) that were never placed."""
    left = blocks.where(P.unmasked_text(F.col("masked")) & ~P.contact_identity(F.col("masked")) & (F.col("kind") != "reference")).join(placed, on, "left_anti")
    short = T.excerpt(T.collapse(F.col("text")), length)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[k for k in on if k != "doc_id"]))
    left = left.withColumn("__rank", rank).withColumn("__short", short)
    some = F.transform(F.array_sort(F.collect_list(F.when(F.col("__rank") <= samples, F.struct("__rank", "__short")))), lambda x: x["__short"])
    return left.groupBy("doc_id").agg(F.count("*").alias("residual"), some.alias("samples"))
