"""Conversation repair beside a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from ectolog.llm import registry, repair

SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("copies", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("turn", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("conv_id", T.LongType()),
    ]
)
GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Plain best-first search: rows are (role, text, fault); returns cost, audit and repaired rows."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, audit, out
        if (at, roles[-1:]) in seen:
            continue
        seen.add((at, roles[-1:]))
        steps = [("I", 0, 5, r, (r, "")) for r in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            steps.append(("D", 1, 2, "", None))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                steps.append(("K", 1, more, role[:1] or "?", (role, text)))
                steps += [("R", 1, 1 + more, r, (r, text)) for r in ("user", "assistant")]
        for letter, step, price, role, row in steps:
            grown = roles + role[:1]
            if grown == roles or re.fullmatch(r"s?(ua)*u?", grown):
                rest = out if row is None else (*out, row)
                heapq.heappush(heap, (cost + price, audit + letter, at + step, grown, rest))


def by_hand(table, damage=True):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if not damage:
            lot = 5
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        rows += [(turn, role, text)] * (2 if lot == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in rows:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            if not shown:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            else:
                fault = None if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit, kept = cheapest(marked)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        count = lambda name: sum(f == name for _, _, f in marked)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            count("blank"),
            count("duplicate"),
            count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def as_dict(df):
    rows = df.collect()
    found = {r[0]: tuple(r[1:]) for r in rows}
    assert len(found) == len(rows)
    return found


def conversations(spark, rows):
    full = [(text, "x", role, turn, None, conv) for conv, turn, role, text in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "umbrella"]
    texts = ["Yes.", "no", "", " \t\n", None, "Ok!", "Ok! \x0b", "é…?", "a.\xa0", "x" * 3000 + ".", "Yes.", "b?"]
    rows = []
    for conv in [*range(120), None]:
        for k in range(rng.randrange(1, 9)):
            turn = rng.choice([k, k, k, k + 1, k + rng.randrange(3), None, -2])
            rows.append((conv, turn, rng.choice(roles[:5] if rng.random() < 0.8 else roles), rng.choice(texts)))
            rows += [rows[-1]] * (rng.random() < 0.1)
    # One turn each, some of which are dropped whole.
    rows += [(1000 + k, 0, "user", "Only this.") for k in range(60)]
    # One large conversation.
    rows += [(500, k, ("user", "assistant")[k % 2], f"{k % 90}{'.' * (k % 7 > 0)}") for k in range(900)]
    rows += [(500, 901, "assistant", "again.")] * 50
    return rows


def test_repair_by_hand(spark, odd):
    df = conversations(spark, odd)
    for damage, rows in ((True, repair.damaged(df)), (False, repair.undamaged(df))):
        want = by_hand(odd, damage)
        assert as_dict(repair.repair_conversations(rows)) == want
        assert as_dict(repair.repair_conversations(rows, block=3)) == want
    lines = {}
    for r in repair.repaired_rows(repair.undamaged(df)).orderBy("conv_id", "position").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    sha = {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()}
    assert sha == {c: w[-1] for c, w in want.items() if w[-1] != hashlib.sha256(b"").hexdigest()}


def test_query_by_hand(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = registry.QUERIES["op11_conversation_repair"](spark, sf_dir)
    assert as_dict(found) == by_hand([tuple(r) for r in table.collect()])


def test_search_and_blocks():
    rng = random.Random(1)
    names = {0: "tool", 1: "system", 2: "user", 3: "assistant"}
    faults = [None, "blank", "duplicate", "truncated"]
    for _ in range(400):
        pairs = [(rng.randrange(4), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(12))]
        codes = bytes(4 * r + f for r, f in pairs)
        want = cheapest([(names[r], "", faults[f]) for r, f in pairs])[:2]
        assert repair.search(codes) == want
        assert repair.repair(codes, 1) == want
    codes = bytes(4 * (2 + k % 2) + (k % 11 == 0) for k in range(5000))
    assert repair.repair(codes, 64) == repair.repair(codes, 100)


def test_empty(spark):
    found = repair.repair_conversations(repair.damaged(conversations(spark, [])))
    assert found.collect() == [] and found.columns[0] == "conv_id"
