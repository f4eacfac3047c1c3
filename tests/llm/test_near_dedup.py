import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quire.llm.near_dedup import _proposed, differing, most_apart, near_dedup, set_prints
from quire.staging import shared_dir


def shingles(text, words=5):
    found = (text or "").lower().split()
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows, least=0.8):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [(i, j, s) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if (s := alike(a, b)) >= 0.5]
    for i, j, s in links:
        if s >= least:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in root}, links


def edited(rng, text, count):
    found = text.split()
    for _ in range(count):
        found[rng.randrange(len(found))] = f"new{rng.randrange(10**6)}"
    return " ".join(found)


def fixture(rng, pairs, size=150):
    rows = []
    for k in range(pairs):
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(size))
        rows += [(2 * k, text), (2 * k + 1, edited(rng, text, 1 + k % 8))]
    return rows


def test_recall_and_precision_around_the_threshold(spark):
    rows = fixture(random.Random(3), 400)
    want, links = plain(rows)
    band = [(i, j) for i, j, s in links if 0.8 <= s <= 0.9]
    below = [(i, j) for i, j, s in links if s < 0.8]
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(band) > 80 and len(below) > 80
    assert sum(got[i] == got[j] for i, j in band) >= 0.98 * len(band)
    assert not any(got[i] == got[j] for i, j in below)
    assert all(want[i] == want[j] for i, j in got.items())


def test_large_groups_propose_in_passes(spark):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    rows = [(i, edited(rng, text, 2 + i % 5)) for i in range(60)] + [(100, None), (101, ""), (102, "a b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [{r.doc_id: r.component_id for r in near_dedup(frame, per_member=n).collect()} for n in (1, 1000)]
    assert found[0] == found[1] == plain(rows)[0]


def test_null_and_repeated_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup(frame).collect()) == [(0, 1, False), (1, 1, True), (2, 1, False), (2, 1, False)]
    frame = spark.createDataFrame([(5, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k"), (None, "g h i j k")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup(frame).collect()) == [(0, 0, True), (0, 0, True), (0, 5, False), (5, 5, True)]
    assert near_dedup(frame.limit(0)).count() == 0


def test_sizes_that_just_reach_the_threshold_link(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(84))  # 80 shingles
    rows = [(k, " ".join([text, *(f"more{n}" for n in range(k))])) for k in (0, 20, 21)]  # 0.8 with 100, less with 101
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()}
    assert got == plain(rows[:2])[0] == {0: 0, 20: 0}
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")).collect()}
    assert got == {0: 0, 21: 21}


@pytest.mark.parametrize("n", [20, 50, 100, 200, 400])
def test_repeated_shingles_count_once(spark, n):
    rng = random.Random(n)
    rows = []
    for k in range(10):
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
        rows += [(2 * k, text + " |" * n), (2 * k + 1, text + " -" * n)]
    want, links = plain(rows)
    assert sum(s >= 0.8 for *_, s in links) == 10
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(10)) >= 9
    assert all(want[i] == want[j] for i, j in got.items())


def test_bits_that_may_differ():
    limits = most_apart(0.8, 640)
    assert differing(5, 4, 4) == pytest.approx(0.1875) and differing(7, 7, 7) == 0
    assert limits[0] == 0 and max(limits) < 200 and limits[-1] < 145
    # the chances of small sets come down to that of large ones
    assert max(differing(40, 50, 40), differing(63, 63, 56)) < limits[-1] / 640
    rng = random.Random(1)
    for a, b, common in ((5, 4, 4), (9, 9, 8), (30, 30, 27), (200, 200, 178)):
        apart = []
        for _ in range(60):
            hashes = np.array([rng.getrandbits(64) for _ in range(a + b - common)], np.uint64)
            one, two = set_prints(np.sort(hashes[:a]), 10), set_prints(np.sort(hashes[a - common :]), 10)
            apart.append(int(np.bitwise_count(one ^ two).sum()))
        assert max(apart) <= limits[min(a, b, len(limits) - 1)]
        assert abs(sum(apart) / 60 / 640 - differing(a, b, common)) < 0.02


def test_only_members_of_waiting_pairs_go_on():
    # 25 members share a block of bits, three of them are near copies: the first pass connects them and one pair waits
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
    prints[7:10] = prints[7] ^ np.array([0, 1, 2], np.uint64)
    nodes = np.arange(100, 125)
    columns = [np.full(25, 5), nodes, prints.view(np.int64), nodes, np.zeros(25, np.int64), np.full(25, 50, np.int64)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "print", "component", "start", "size"])
    found = [r for b in _proposed(iter([batch]), distance=3, per_member=0, least=0.8) for r in b.to_pylist()]
    pairs, more = [r for r in found if r["key"] is None], [r for r in found if r["key"] is not None]
    assert len(pairs) == 2 and {r[x] for r in pairs for x in "ab"} == {107, 108, 109}
    assert len(more) == 2 and {r["a"] for r in more} < {107, 108, 109} and {(r["key"], r["next"], r["size"]) for r in more} == {(5, 0, 50)}


def test_shingles_go_when_all_pairs_are_settled(spark):
    before = set(Path(shared_dir(spark)).glob("near-prints-*"))
    near_dedup(spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "g h")], "doc_id long, text string"))
    assert set(Path(shared_dir(spark)).glob("near-prints-*")) == before
