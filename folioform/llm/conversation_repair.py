"""Cheapest repair of conversations: which turns to keep, rename or delete, and where to insert empty ones.

A repaired conversation is an optional system turn, then user and assistant in turn, ending with the assistant (or it is empty). That
is an automaton of four states. Each turn is a 4x4 matrix over (cost, audit): entry [i][j] is the cheapest way from state i to j that
uses up the turn by one edit, after any number of insertions (the insertions' closure), and its edits' initials. Entries are joined by
adding costs and joining audits, and chosen by the smaller cost, then by the audit that is least in ASCII. At equal cost no audit of the
same turns is the beginning of another (it would only lack insertions, which cost), so choosing early or late gives the same and matrix
products may be taken in any grouping.

Turns are dealt out by ranges of (conversation, turn), so a long conversation lies in many tasks. Each task multiplies what it has of a
conversation by a tree; conversations that go over a range's border, at most two a range, are multiplied by a tree over ranges, FAN_IN
at a time. Rows sent there are narrow: a text is only its hash and what is wrong with it. Equal rows go as one with a count.

Texts are shuffled once, if the repaired texts are wanted at all, to where their conversation's audit goes; they stream through there.
A digest of a whole conversation is worked out in order by one task, as SHA-256 is defined, with one text in memory.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import checkpointed, table

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. A repaired conversation ends in ENDS.
STATES, ENDS = 4, (0, 3)
#: Where a turn leads from a state, by its role's initial.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Pairs of neighbouring initials that are in order.
LEGAL = frozenset(("su", "ua", "au"))
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Ranges whose parts of a conversation are multiplied in one task.
FAN_IN = 16

_SPACES = " \t\n\x0b\x0c\r"

Matrix = list[tuple[int, str] | None]

IDENTITY: Matrix = [(0, "") if i == j else None for i in range(STATES) for j in range(STATES)]


def better(a: Matrix, b: Matrix) -> Matrix:
    return [x if y is None or x is not None and x <= y else y for x, y in zip(a, b)]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The cheapest ways through a and then b."""
    out: Matrix = [None] * (STATES * STATES)
    for i in range(0, STATES * STATES, STATES):
        for k in range(STATES):
            x = a[i + k]
            if x is None:
                continue
            cost, audit = x
            for j in range(STATES):
                y = b[STATES * k + j]
                if y is not None:
                    now, was = cost + y[0], out[i + j]
                    if was is None or now < was[0] or now == was[0] and audit + y[1] < was[1]:
                        out[i + j] = (now, audit + y[1])
    return out


def power(m: Matrix, n: int) -> Matrix:
    out = IDENTITY
    while n:
        if n & 1:
            out = times(out, m)
        n >>= 1
        if n:
            m = times(m, m)
    return out


def _closure() -> Matrix:
    """Any number of insertions. More than two in a row come back to a state they passed."""
    one: Matrix = [None] * (STATES * STATES)
    for name in ("u", "a"):
        for i, j in STEPS[name].items():
            one[STATES * i + j] = (INSERT, "I")
    return better(better(IDENTITY, one), times(one, one))


CLOSURE = _closure()


def _turn(initial: str, faulty: bool, truncated: bool) -> Matrix:
    ways: Matrix = [(DELETE, "D") if i == j else None for i in range(STATES) for j in range(STATES)]
    more = TRUNCATED * truncated
    for cost, letter, names in () if faulty else ((RENAME, "R", ("u", "a")), (0, "K", (initial,))):
        for name in names:
            for i, j in STEPS.get(name, {}).items():
                at = STATES * i + j
                ways[at] = min((cost + more, letter), ways[at] or (cost + more, letter))
    return times(CLOSURE, ways)


DELETED = _turn("", True, False)
TURNS = {(name, cut): _turn(name, False, cut) for name in ("s", "u", "a", "") for cut in (False, True)}


class Part:
    """A stretch of a conversation's turns: its matrix and what its turns add to the counts, by which two neighbours are joined."""

    FIELDS = "cost array<bigint>, audit array<string>, n bigint, first string, last string, illegal bigint, blank bigint, duplicate bigint, truncated bigint, low bigint, high bigint, turns bigint"
    __slots__ = ("matrix", "n", "first", "last", "illegal", "blank", "duplicate", "truncated", "low", "high", "turns")

    def __init__(self, matrix=IDENTITY, n=0, first=None, last=None, illegal=0, blank=0, duplicate=0, truncated=0, low=None, high=None, turns=0) -> None:
        self.matrix, self.n, self.first, self.last, self.illegal = matrix, n, first, last, illegal
        self.blank, self.duplicate, self.truncated, self.low, self.high, self.turns = blank, duplicate, truncated, low, high, turns

    @classmethod
    def of(cls, turn: int | None, role: str, n: int, blank: bool, repeated: bool, truncated: bool) -> Part:
        """n equal rows. All but the first are duplicates, the first is if it is `repeated`; n of 0 stands for dropped rows."""
        if not n:
            return cls()
        name, faulty = role[:1], blank or repeated
        matrix = DELETED if faulty else TURNS[name if name in STEPS else "", truncated]
        if n > 1:
            matrix = times(matrix, power(DELETED, n - 1))
        copies = 0 if blank else n if repeated else n - 1
        return cls(matrix, n, name, name, n - 1, n if blank else 0, copies, int(truncated and not faulty), turn, turn, int(turn is not None))

    @classmethod
    def read(cls, row: dict) -> Part:
        matrix = [None if c is None else (c, a) for c, a in zip(row["cost"], row["audit"])]
        return cls(matrix, *[row[k] for k in cls.__slots__[1:]])

    def row(self) -> dict:
        cells = [x or (None, None) for x in self.matrix]
        return {"cost": [c for c, _ in cells], "audit": [a for _, a in cells]} | {k: getattr(self, k) for k in self.__slots__[1:]}

    def then(self, other: Part) -> Part:
        if not self.n or not other.n:
            return other if not self.n else self
        border = int(self.last + other.first not in LEGAL)
        same = int(self.high is not None and self.high == other.low)
        return Part(
            times(self.matrix, other.matrix), self.n + other.n, self.first, other.last, self.illegal + other.illegal + border, self.blank + other.blank,
            self.duplicate + other.duplicate, self.truncated + other.truncated, other.low if self.low is None else self.low, self.high if other.high is None else other.high, self.turns + other.turns - same,
        )

    def plan(self) -> dict:
        """The whole conversation's row."""
        last = times(self.matrix, CLOSURE)
        cost, audit = min(x for x in (last[k] for k in ENDS) if x is not None) if self.n else (0, "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


PLAN = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


class Tree:
    """Joins parts that come in order, always two of the same size: a balanced tree of which one part a level is held."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Part]] = []

    def add(self, part: Part) -> None:
        level = 0
        while self.held and self.held[-1][0] == level:
            part = self.held.pop()[1].then(part)
            level += 1
        self.held.append((level, part))

    def all(self) -> Part:
        out = Part()
        for _, part in reversed(self.held):
            out = part.then(out)
        return out


def turns(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, copies) with nulls of role and text as one space, and the text's hashes __a and __b.

    `copies` is how often a row stands there (1 unless given); 0 drops it, but its conversation stays.
    """
    held = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    return held.withColumn("__a", F.xxhash64("text")).withColumn("__b", F.xxhash64(F.lit("b"), "text"))


_ORDER = ("conv_id", "turn", "role", "__a", "__b")  # nulls come first


def _facts(held: DataFrame) -> DataFrame:
    """One narrow row for each set of equal turns: how many, and whether they are blank, truncated or were said in an earlier turn."""
    trimmed = F.rtrim("text", F.lit(_SPACES))
    facts = held.select(*_ORDER, (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated"), "copies")
    facts = facts.groupBy(*_ORDER, "blank", "truncated").agg(F.sum("copies").alias("n"))
    live = F.col("n") > 0
    said = facts.groupBy(*[F.col(k).alias(f"{k}2") for k in ("conv_id", "role", "__a", "__b")]).agg(F.min(F.when(live, F.col("turn"))).alias("__least"), F.count_if(live & F.col("turn").isNull()).alias("__nulls"))
    # A hash of the keys is one more key, so that the rows of a hot key are dealt out for the join and can be split.
    keys = ("conv_id", "role", "__a", "__b")
    match = F.xxhash64(*keys) == F.xxhash64(*[f"{k}2" for k in keys])
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}2"))
    earlier = F.col("turn").isNotNull() & ((F.col("__nulls") > 0) | (F.col("__least") < F.col("turn")))
    return facts.join(said, match).select(*_ORDER, "n", "blank", "truncated", earlier.alias("repeated"))


def repair_plans(held: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conv_id of turns().

    Turns are taken by number, nulls first; of one number by role and then by a hash of the text. A null conv_id is a conversation like
    any other, null roles and texts are one space, equal rows are duplicates. A conversation of which nothing is left gives zeros and an
    empty audit; an empty table gives no rows; other columns are ignored. Texts are equal if two 64-bit hashes of theirs are.
    """
    kind = held.schema["conv_id"].dataType.simpleString()

    def scan(batches):
        """One row a conversation of the range; those at its borders keep their matrix, as they may go on in other ranges."""
        now, tree, head = None, None, True
        names = ["conv_id", "edge", "part", *[f.split()[0] for f in PLAN.split(", ")]]

        def row(edge: bool) -> dict:
            part = tree.all()
            return {"conv_id": now, "edge": edge, "part": part.row() if edge else None} | (dict.fromkeys(names[3:]) if edge else part.plan())

        for batch in batches:
            out = []
            for conv, turn, role, n, blank, truncated, repeated in zip(*[batch.column(k).to_pylist() for k in range(7)]):
                if tree is None or conv != now:
                    if tree is not None:
                        out.append(row(head))
                        head = False
                    now, tree = conv, Tree()
                tree.add(Part.of(turn, role, n, blank, repeated, truncated))
            if out:
                yield out
        if tree is not None:
            yield [row(True)]

    whole = f"conv_id {kind}, edge boolean, part struct<{Part.FIELDS.replace(' ', ': ').replace(',: ', ', ')}>, {PLAN}"
    arrow = _arrow(whole)
    ranged = _facts(held).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("conv_id", "turn", "role", "n", "blank", "truncated", "repeated")
    scanned = ranged.mapInArrow(lambda batches: (pa.RecordBatch.from_pylist(out, schema=arrow) for out in scan(batches)), whole)
    scanned = checkpointed(scanned.withColumn("range", F.spark_partition_id()))
    borders = scanned.where("edge").select("conv_id", "range", "part.*")
    ranges = scanned.rdd.getNumPartitions()

    def joined(last: bool):
        made = _arrow(f"conv_id {kind}, {PLAN}" if last else f"conv_id {kind}, range int, {Part.FIELDS}")

        def join(rows: pa.Table) -> pa.Table:
            found = sorted(rows.to_pylist(), key=lambda r: r["range"])
            tree = Tree()
            for r in found:
                tree.add(Part.read(r))
            part = tree.all()
            return pa.Table.from_pylist([{"conv_id": found[0]["conv_id"]} | (part.plan() if last else {"range": found[0]["range"]} | part.row())], schema=made)

        return join

    width = FAN_IN
    while width < ranges:
        groups = borders.groupBy("conv_id", F.floor(F.col("range") / width).alias("__group"))
        borders = groups.applyInArrow(joined(False), f"conv_id {kind}, range int, {Part.FIELDS}")
        width *= FAN_IN
    plans = borders.groupBy("conv_id").applyInArrow(joined(True), f"conv_id {kind}, {PLAN}")
    return scanned.where("not edge").select(*plans.columns).unionByName(plans)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def repaired_turns(audit: str, rows):
    """Yields (edit, role, text, row) of a repaired conversation from its audit and its turns (role, text, ...) in order; row is None for insertions."""
    state, at = 0, 0

    def inserted():
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            at += 1
            role, state = ("assistant", 3) if state == 2 else ("user", 2)
            yield "I", role, "", None

    for row in rows:
        yield from inserted()
        edit, role = audit[at], row[0]
        at += 1
        if edit == "D":
            continue
        if edit == "R":
            role = "assistant" if state == 2 else "user"
        state = STEPS[role[:1]][state]
        yield edit, role, row[1], row
    yield from inserted()


def _walked(held: DataFrame, plans: DataFrame, give, schema: str) -> DataFrame:
    """give(plan, turns) for each conversation: its plan's row, and its turns (role, text, turn), streamed in order."""
    carried = F.struct(*[c for c in plans.columns if c != "conv_id"])
    heads = plans.select("conv_id", F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("long").alias("__a"), F.lit(None).cast("long").alias("__b"), F.lit(None).cast("string").alias("text"), F.lit(1).cast("long").alias("copies"), carried.alias("plan"))
    rows = held.where("copies > 0").select("conv_id", F.lit(1).alias("__kind"), "turn", "role", "__a", "__b", "text", "copies", F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"))
    together = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "__kind", *_ORDER[1:]).select("__kind", "conv_id", "role", "text", "turn", "copies", "plan")
    arrow = _arrow(schema)

    def scan(batches):
        def stream():
            for batch in batches:
                yield from zip(*[batch.column(k).to_pylist() for k in range(7)])

        source = stream()
        ahead = [next(source, None)]

        def own():
            while (x := ahead[0]) is not None and x[0]:
                for _ in range(x[5]):
                    yield x[2], x[3], x[4]
                ahead[0] = next(source, None)

        out = []
        while (x := ahead[0]) is not None:
            ahead[0] = next(source, None)
            for row in give({"conv_id": x[1]} | x[6], own()):
                out.append(row)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return together.mapInArrow(scan, schema)


def repaired(held: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text, turn): the repaired conversations, positions from 0; turn is null for insertions.

    Conversations of which nothing is left have no rows.
    """

    def give(plan, rows):
        for k, (edit, role, text, row) in enumerate(repaired_turns(plan["audit"], rows)):
            yield {"conv_id": plan["conv_id"], "position": k, "edit": edit, "role": role, "text": text, "turn": row and row[2]}

    return _walked(held, plans, give, f"conv_id {held.schema['conv_id'].dataType.simpleString()}, position long, edit string, role string, text string, turn long")


def with_digests(held: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans with repaired_sha256, the digest of the repaired conversation's `role:text` joined by newlines."""

    def give(plan, rows):
        digest, between = hashlib.sha256(), ""
        for _, role, text, _ in repaired_turns(plan["audit"], rows):
            digest.update(f"{between}{role}:{text}".encode())
            between = "\n"
        yield plan | {"repaired_sha256": digest.hexdigest()}

    schema = StructType([*plans.schema.fields, StructField("repaired_sha256", StructType.fromDDL("x string")["x"].dataType)])
    return _walked(held, plans, give, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields))


def damaged(rows: DataFrame) -> DataFrame:
    """turns() of the rows after damage that a CRC-32 of conv_id and turn decides: one in five is dropped, emptied, unended, doubled or renamed."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(h == 4, F.lit("user")).otherwise(F.col("role"))
    held = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("__copies"))
    return turns(held, F.col("__copies"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage: what is wrong with them, their cheapest repair and its digest."""
    held = damaged(table(spark, sf_dir, "conversations"))
    return with_digests(held, repair_plans(held))
