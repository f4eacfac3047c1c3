"""Sharding by Karmarkar-Karp differencing of indivisible groups."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import HEAVY, heavy_hitters, lookup, numbered, text_or_empty, written

#: Groups that one task differences on average, and partial partitions merged by one task of a later level.
GROUPS_PER_TASK, FAN_IN = 20_000, 1024


def differenced(partials: Iterable[Sequence[int]], parts: int) -> list[list[int]]:
    """The part that each slot of each partial partition goes to, so that the parts' sums are near equal.

    A partial partition is `parts` sums (a single item of weight w is w and zeros). The two with the largest
    spread are combined, the largest sum of one with the smallest of the other, until one is left. Ties are
    taken in the given order, so a repeated task gives the same answer.
    """
    heap: list[tuple] = []
    for k, sums in enumerate(partials):
        ranked = sorted(range(parts), key=lambda s: (-sums[s], s))
        ordered = [sums[s] for s in ranked]
        heap.append((ordered[-1] - ordered[0], k, ordered, [((k, s), None, None) for s in ranked]))
    if not heap:
        return []
    count = len(heap)
    heapq.heapify(heap)
    made = count
    while len(heap) > 1:
        _, _, a, trees_a = heapq.heappop(heap)
        _, _, b, trees_b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b), strict=True)]
        trees = [(None, x, y) for x, y in zip(trees_a, reversed(trees_b), strict=True)]
        ranked = sorted(range(parts), key=sums.__getitem__, reverse=True)
        ordered = [sums[s] for s in ranked]
        heapq.heappush(heap, (ordered[-1] - ordered[0], made, ordered, [trees[s] for s in ranked]))
        made += 1
    target = [[0] * parts for _ in range(count)]
    for part, tree in enumerate(heap[0][3]):
        stack = [tree]
        while stack:
            leaf, left, right = stack.pop()
            if leaf is not None:
                target[leaf[0]][leaf[1]] = part
            else:
                stack += (left, right)
    return target


def _difference_groups(frame: pd.DataFrame, parts: int) -> pd.DataFrame:
    frame = frame.sort_values(["weight", "digest"], ascending=[False, True], kind="stable")
    target = differenced(([w] + [0] * (parts - 1) for w in frame["weight"].tolist()), parts)
    return frame.assign(part=[t[0] for t in target])[["digest", "bucket", "part", "weight"]]


def _difference_partials(frame: pd.DataFrame, parts: int) -> pd.DataFrame:
    wide = frame.pivot_table(index="bucket", columns="part", values="weight", aggfunc="sum", fill_value=0).reindex(columns=range(parts), fill_value=0).sort_index()
    target = differenced((list(map(int, row)) for row in wide.to_numpy()), parts)
    parent = int(frame["parent"].iloc[0])
    return pd.DataFrame([(b, s, parent, t[s]) for b, t in zip(wide.index, target, strict=True) for s in range(parts)], columns=["bucket", "part", "parent", "new_part"])


def balanced_parts(groups: DataFrame, parts: int, per_task: int = GROUPS_PER_TASK, fan_in: int = FAN_IN) -> DataFrame:
    """`digest`, `part` for groups of (`digest`, `weight`): the parts' weights are near equal.

    Every task differences the groups of one hash bucket down to one partial partition; what is left of all
    buckets is differenced again, `fan_in` of them a task, until the last ones (at most `fan_in` times
    `parts` sums, a fixed bound) are differenced on the driver. Groups that outweigh a quarter of a bucket's
    part, fewer than 4 * parts * fan_in, would upset their bucket: they wait for the last round, where the
    buckets' parts are then single items, so that light parts make room for heavy groups.
    """
    spark = groups.sparkSession
    size = groups.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total")).first()
    buckets = max(1, -(-size["n"] // per_task))
    most = size["total"] // (4 * parts * min(buckets, fan_in))
    heavy = [] if buckets == 1 else groups.where(F.col("weight") > most).orderBy(F.desc("weight"), "digest").collect()
    light = groups.where(F.col("weight") <= most) if heavy else groups
    if heavy:
        buckets = max(buckets, min(64, fan_in))
    dealt = light.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    placed = written(dealt.groupBy("bucket").applyInPandas(lambda f: _difference_groups(f, parts), "digest string, bucket long, part int, weight long"), "shard-groups")
    while buckets > fan_in:
        sums = placed.groupBy("bucket", "part").agg(F.sum("weight").alias("weight")).withColumn("parent", F.floor(F.col("bucket") / fan_in))
        moves = written(sums.groupBy("parent").applyInPandas(lambda f: _difference_partials(f, parts), "bucket long, part int, parent long, new_part int"), "shard-moves")
        placed = written(placed.join(moves, ["bucket", "part"]).select("digest", F.col("parent").alias("bucket"), F.col("new_part").alias("part"), "weight"), "shard-groups")
        buckets = -(-buckets // fan_in)
    last = placed.groupBy("bucket", "part").agg(F.sum("weight").alias("weight")).orderBy("bucket", "part").collect()  # at most fan_in * parts rows
    if heavy:
        singles = [r.weight for r in heavy] + [r.weight for r in last]
        target = differenced(([w] + [0] * (parts - 1) for w in singles), parts)
        moves = [(r.bucket, r.part, t[0]) for r, t in zip(last, target[len(heavy) :], strict=True)]
        apart = spark.createDataFrame([(r.digest, t[0]) for r, t in zip(heavy, target, strict=False)], "digest string, part int")
    else:
        sums: dict[int, list[int]] = {}
        for row in last:
            sums.setdefault(row.bucket, [0] * parts)[row.part] = row.weight
        target = differenced(sums.values(), parts)
        moves = [(b, s, t[s]) for b, t in zip(sums, target, strict=True) for s in range(parts)]
    final = spark.createDataFrame(moves, "bucket long, part int, shard int")
    found = placed.join(F.broadcast(final), ["bucket", "part"]).select("digest", F.col("shard").alias("part"))
    return found.unionByName(apart) if heavy else found


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", per_task: int = GROUPS_PER_TASK, fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Rows of equal text form a group that is never divided (a null text counts as empty and has size 1);
    groups are put into `shards` shards of near equal bytes by differencing. A group larger than a shard's
    share fills one shard alone. `slot` is gapless from 0 in each shard, in the order of a hash of doc_id;
    repeated rows have a slot each. An empty table gives no rows.
    """
    text = text_or_empty(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = written(sized, "shard-rows")
    heavy = written(heavy_hitters(rows, "digest", HEAVY), "shard-heavy")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("weight")), "shard-weights")
    placed = written(lookup(rows, balanced_parts(groups, shards, per_task, fan_in), heavy, "digest"), "shard-placed")
    slots = numbered(placed.withColumnRenamed("part", "shard"), ["shard"], ["doc_id", "_row"], "slot", placed.count())
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
