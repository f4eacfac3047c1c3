import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm.queries import ORACLES, QUERIES
from quire.llm.turns import audits, damaged, repair, repaired, solve, undamaged

WANTED = re.compile(r"(s?(ua)+)?\Z")


def plain_solve(signature):
    """All edit sequences in order of cost and string; the roles written are part of the search state, whole."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        if at == len(signature) and WANTED.match(out):
            return audit, cost
        if (at, out) in seen or len(out) > len(signature) + 2:
            continue
        seen.add((at, out))
        for c in "ua":
            heapq.heappush(heap, (cost + 5, audit + "I", at, out + c))
        if at < len(signature):
            code = signature[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, out))
            if code != "x":
                stays = 5 * code.isupper()
                heapq.heappush(heap, (cost + stays, audit + "K", at + 1, out + code.lower()))
                for c in "ua":
                    heapq.heappush(heap, (cost + stays + 1, audit + "R", at + 1, out + c))


def test_every_short_signature_equals_the_search():
    for size in range(4):
        for letters in itertools.product("suaoSUAOx", repeat=size):
            assert solve("".join(letters)) == plain_solve("".join(letters)), letters


def test_longer_signatures():
    rng = random.Random(1)
    for _ in range(60):
        s = "".join(rng.choices("suaoUAx", (1, 6, 6, 1, 1, 1, 2), k=rng.randint(4, 7)))
        assert solve(s) == plain_solve(s), s
    assert solve("ua" * 150_000) == ("K" * 300_000, 0)
    assert solve("uu" * 1000) == ("KR" * 1000, 1000)


def plain(rows, damage=True):
    """{conv_id: all columns} by straight loops."""
    by, out = {}, {}
    for conv, turn, role, text in rows:
        key = " ".join([" " if conv is None else str(conv)]) + ":" + (" " if turn is None else str(turn))
        kind = zlib.crc32(key.encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by.setdefault(conv, []).extend([(turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, found in by.items():
        found.sort()
        turns = [t for has, t, *_ in found if has]
        signature, seen, counts = "", set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        initials = [r[2][:1] for r in found]
        for _, _, role, _, text in found:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
        audit, cost = solve(signature)
        lines, rest, state = [], iter(found), ""
        for letter in audit:
            row = None if letter == "I" else next(rest)
            if letter != "D":
                role = row[2] if letter == "K" else "assistant" if state == "u" else "user"
                lines.append(f"{role}:{row[4] if row else ''}")
                state = role[0]
        assert WANTED.match("".join(x[0] for x in lines))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(rng, convs):
    rows = []
    for conv in range(convs):
        said = ["", " \t", "Yes.", "No", "Why? ", "é!\n", None, "a\nb."]
        for turn in range(rng.randint(1, 9)):
            turn = rng.choice((turn, turn, turn, 3 * turn, None, turn // 2))
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", None, "", "ushers"))
            rows.append((conv, turn, role, rng.choice(said) if rng.random() < 0.5 else f"words {rng.random()}{rng.choice('.?!,')}"))
    return rows


KIND = "conv_id long, turn long, role string, text string"


def got(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("damage", [True, False])
def test_equals_the_loops(spark, damage):
    rows = made(random.Random(3), 150)
    rows += rows[:30]  # repeated rows
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (1000, None, None, None), (1001, 0, "user", "x" * 300_000)]
    assert got(repair(spark.createDataFrame(rows, KIND).withColumn("audit", F.lit(1)).repartition(5), damage)) == plain(rows, damage)


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(7, k // 2 if k % 3 else k, rng.choice(("user", "assistant", "system")), f"text {rng.randrange(300)}{rng.choice('.,')}") for k in range(4000)]
    rows += [(7, None, "user", "Same."), (8, 1, "user", "Hi.")] + [(7, 5, "user", "Same.")] * 500
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(repair(spark.createDataFrame(rows, KIND))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lost_conversations_extreme_turns_and_empty_table(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Hi."), (-5, -(2**63), "user", "Hi."), (-5, 2**63 - 1, "assistant", "Ho.")]
    found = got(repair(spark.createDataFrame(rows, KIND)))
    assert found[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[-5][0] is None
    assert got(repair(spark.createDataFrame(rows[1:], KIND), damage=False))[-5][5:7] == (0, "KK")
    assert repair(spark.createDataFrame(rows, KIND).limit(0)).count() == 0
    names = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "user", "Ho."), (None, 0, "x", "Y")], KIND.replace("conv_id long", "conv_id string"))
    assert {k: v[5:7] for k, v in got(repair(names, damage=False)).items()} == {"a": (1, "KR"), None: (2, "D")}


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "So?"), (2, 4, "assistant", "Yes."), (3, 0, "user", "cut"), (4, 0, "user", "A."), (4, 1, "assistant", "B."), (4, 2, "user", "C.")]
    frame = undamaged(spark.createDataFrame(rows, KIND))
    found = repaired(frame, audits(frame)).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in found] == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "So?"), (4, 0, "K", "user", "A."), (4, 1, "K", "assistant", "B.")]
    assert damaged(spark.createDataFrame(rows, KIND)).count() == len(rows)


def test_query_and_its_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet'")
    found = QUERIES["op12_turns"](spark, at)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES['op12_turns']})").fetchall()
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(found) == plain(rows) == {r[0]: tuple(r[1:]) for r in want}
