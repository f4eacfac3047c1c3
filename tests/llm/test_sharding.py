import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.sharding import differenced, shard


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=60), st.integers(1, 6))
def test_differencing_places_every_item(weights, parts):
    target = differenced(([w] + [0] * (parts - 1) for w in weights), parts)
    sums = [0] * parts
    for w, t in zip(weights, target, strict=True):
        sums[t[0]] += w
    assert sum(sums) == sum(weights)
    assert max(sums) - min(sums) <= max(weights, default=0)


@pytest.mark.parametrize(("per_task", "fan_in"), [(20_000, 1024), (10, 1024), (10, 8)])  # the last needs several levels
def test_shards_are_balanced_and_groups_whole(spark, odd_rows, per_task, fan_in):
    rng = random.Random(1)
    rows = odd_rows + [(1000 + i, "x" * rng.randint(1, 900)) for i in range(600)] + [(3000 + i, "one text") for i in range(200)]
    got = shard(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int").repartition(5), 8, per_task=per_task, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    where, sums, slots = defaultdict(set), [0] * 8, defaultdict(list)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        where[data].add(r.shard)
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((t or "").encode()) + 1 for t in texts.values())
    assert max(sums) <= max(sum(sums) / 8 * (1.1 if fan_in == 8 else 1.02) + 50, largest)


def test_a_group_beyond_a_shards_share_has_a_shard_alone(spark):
    rows = [(i, "copies of one text " * 20) for i in range(300)] + [(1000 + i, f"{i} " * (i % 90 + 1)) for i in range(900)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 8, per_task=50).collect()
    sums, alone = defaultdict(int), {r.shard for r in got if r.doc_id < 300}
    for r in got:
        sums[r.shard] += r.size
    others = [n for s, n in sums.items() if s not in alone]
    assert len(alone) == 1 and len(others) == 7 and {r.shard for r in got if r.doc_id >= 1000} == set(sums) - alone
    assert max(others) - min(others) <= 0.05 * max(others)


def test_empty_table_and_nulls(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = shard(spark.createDataFrame([(None, None), (1, ""), (1, None)], "doc_id long, text string")).collect()
    assert len(got) == 3 and len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == [0, 1, 2]
