"""Conversation repair against a search for the cheapest edits, conversation by conversation."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from folioform.llm import conversation_repair as C

NEXT = {("", "s"): "S", ("", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def damage(rows):
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        yield from [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)


def faults(rows):
    said, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in said else "truncated" if bare[-1] not in ".!?" else "")
        said.add((role, text))
    return out


def cheapest(rows, wrong):
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "A"):
            return cost, audit, out
        for role in ("user", "assistant"):
            if to := NEXT.get((state, role[0])):
                heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, (role, ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if wrong[i] in ("", "truncated"):
                more = int(wrong[i] == "truncated")
                for now, letter, name in ((0, "K", role), (2, "R", "user"), (2, "R", "assistant")):
                    if to := NEXT.get((state, name[:1])):
                        heapq.heappush(heap, (cost + now + more, audit + letter, i + 1, to, (*out, (name, text))))


def brute(rows):
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        wrong = faults(own)
        cost, audit, kept = cheapest(own, wrong)
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        text = "\n".join(f"{role}:{text}" for role, text in kept)
        out[conv] = (gaps, *[wrong.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def some_rows():
    rng, rows = random.Random(3), []
    for conv in [*range(60), None]:
        for turn in [*([None] if rng.random() < 0.3 else []), *range(rng.randrange(1, 14))]:
            if rng.random() > 0.1:
                role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
                rows.append((conv, turn, role, rng.choice(["Hi.", "Yes!", "what", "  ", "", None, f"No {rng.randrange(9)}?", f"x {rng.randrange(99)}.\x0b "])))
    return rows + [(7777, k, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"t {k % 400}.") for k in range(600)]


@pytest.mark.parametrize("ranges", [4, 40])
def test_against_a_search(spark, ranges):
    """Many ranges part conversations, so that the tree has two levels."""
    rows = some_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, n int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        held = C.damaged(df)
        plans = C.repair_plans(held)
        got = {r[0]: tuple(r)[1:] for r in C.with_digests(held, plans).collect()}
        kept = C.repaired(held, plans).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows)
    for conv in got:
        own = sorted((r for r in kept if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in own))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == got[conv][-1]


def test_query_against_a_search(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = C.op13_conversation_repair(spark, data)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute(rows)


def test_equal_rows_long_texts_and_an_empty_table(spark):
    rows = [(1, 0, "user", "Hi.")] * 500 + [(1, 1, "assistant", "y" * 200_000 + ".")] + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.repair_plans(C.turns(df)).collect()}
    assert (got[1]["duplicate"], got[1]["cost"], got[1]["audit"], got[1]["illegal"]) == (499, 3 * 499, "K" + "D" * 499 + "K", 499)
    assert (got[None]["blank"], got[None]["cost"], got[None]["audit"], got[None]["gaps"]) == (3, 9, "DDD", 0)
    empty = C.turns(df.limit(0))
    plans = C.repair_plans(empty)
    assert plans.count() == 0 and C.with_digests(empty, plans).count() == 0
    dropped = C.turns(df, C.F.lit(0))
    assert [tuple(r)[1:] for r in C.repair_plans(dropped).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_products_in_any_grouping():
    rng = random.Random(5)
    for _ in range(200):
        row = [C.TURNS[rng.choice([("s", False), ("u", False), ("a", True), ("", False), ("u", True)])] if rng.random() < 0.8 else C.DELETED for _ in range(6)]
        left = C.IDENTITY
        for m in row:
            left = C.times(left, m)
        right = C.IDENTITY
        for m in reversed(row):
            right = C.times(m, right)
        assert left == right == C.times(C.times(C.times(row[0], row[1]), row[2]), C.times(row[3], C.times(row[4], row[5])))
    assert C.power(C.DELETED, 5)[0] == (15, "DDDDD")
