import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.simhash import block_masks, gray_rank, near_chunks, simhash_dedup


def plain_fingerprint(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[tuple[int, int]]) -> dict[int, int]:
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in prints}


def test_matches_all_pairs(spark, odd_rows):
    rows = odd_rows + [(200 + i, (t or "") + " tail") for i, t in odd_rows[:40]]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(list(prints.items()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (20_000, 1):  # the second cuts every shared block again
        got = simhash_dedup(frame, most_in_block=most).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (prints[i], want[i]) for i in prints}


def test_any_of_several_fingerprints_links(spark, odd_rows):
    from quire.llm.simhash import fingerprint

    rows = odd_rows[:-2] + [(200 + i, (t or "") + " one more tail") for i, t in odd_rows[:40]]
    prints = {i: fingerprint((t or "").encode(), 5, 3) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in prints.items():
        for j, b in prints.items():
            if i < j and any((x ^ y).bit_count() <= 4 for x, y in zip(a, b, strict=True)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=5, distance=4, rounds=3)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in prints}
    assert len({p for row in prints.values() for p in row if any(row)}) > 2 * len({tuple(row) for row in prints.values()})


def test_empty_table_and_extra_columns(spark):
    assert simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    frame = spark.createDataFrame([(1, "a b c d", 5), (2, "a b c d", 6), (None, "a b c d", 7)], "doc_id long, text string, component_id int")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash_dedup(frame).collect()) == [(0, 1), (1, 1), (2, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2**64 - 1), st.integers(0, 63), st.integers(0, 63)), min_size=1, max_size=60))
def test_index_finds_every_pair(rows):
    pairs = sorted({(g, p ^ (1 << a) ^ (1 << b)) for g, p, a, b in rows} | {(g, p) for g, p, _, _ in rows})
    group, prints = np.array([g for g, _ in pairs]), np.array([p for _, p in pairs], np.uint64)
    order = np.lexsort((gray_rank(prints), group))
    group, prints = group[order], prints[order]
    a, b = (np.concatenate(x) for x in zip(*near_chunks(prints, group, 2), strict=True))
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if group[i] == group[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


def test_gray_rank_inverts_the_code():
    ranks = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


def test_blocks_cover_all_bits_once():
    masks = block_masks((1 << 64) - 1, 3)
    assert sum(masks) == (1 << 64) - 1 and all(not a & b for i, a in enumerate(masks) for b in masks[:i])
