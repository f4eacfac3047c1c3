"""What several operators share: written tables, heavy hitters, skew-safe lookups, numbering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.staging import shared_dir, written

__all__ = ["HEAVY", "carried", "heavy_hitters", "lookup", "numbered", "shared_dir", "split_heavy", "spread", "text_or_empty", "whole_keys", "written"]

#: Entries a task keeps while it looks for frequent values; also the most that are ever broadcast.
HEAVY = 1024
#: Rows that one window partition of a numbering holds on average, and the most such partitions.
ROWS_PER_BUCKET, MOST_BUCKETS = 20_000, 4096


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def carried(carry: Sequence[str], own: Sequence[str]) -> list[str]:
    """The columns `carry`; an error where one has the name (in any case) of a result column of the operator's own."""
    if clash := sorted({c.lower() for c in carry} & {c.lower() for c in own}):
        raise ValueError(f"columns to carry have names of result columns: {', '.join(clash)}")
    return list(carry)


def _misra_gries(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        for pair in pc.value_counts(batch.column(0)):
            value = pair["values"].as_py()
            held[value] = held.get(value, 0) + pair["counts"].as_py()
        if len(held) > most:
            cut = sorted(held.values(), reverse=True)[most]
            held = {v: n - cut for v, n in held.items() if n > cut}
    held = {v: n for v, n in held.items() if n > 1}
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["value", "n"])


def heavy_hitters(df: DataFrame, key: str, most: int = HEAVY) -> DataFrame:
    """The frequent values of the string column `key`, as one column of that name with at most `most` rows.

    Misra-Gries: each task keeps `most` counters and lowers all of them when they overflow, so a value's
    summed counters fall short of its count by at most rows / (most + 1). A value with over twice that many
    rows is always among the `most` largest sums, which makes the result's size a proven bound. The counters
    are lower bounds and only choose candidates; whoever uses them counts anew.
    """
    found = df.select(F.col(key).cast("string").alias("value")).where("value is not null").mapInArrow(lambda it: _misra_gries(it, most), "value string, n long")
    return found.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(most).select(F.col("value").alias(key))


def split_heavy(df: DataFrame, heavy: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is heavy, and the others; `heavy` is bounded, so it is broadcast."""
    few = F.broadcast(heavy)
    return df.join(few, key, "left_semi"), df.join(few, key, "left_anti")


def lookup(rows: DataFrame, table: DataFrame, heavy: DataFrame, key: str) -> DataFrame:
    """Inner join with `table` (one row per key): heavy keys on the map side, the rest by a shuffle."""
    rows_heavy, rows_light = split_heavy(rows, heavy, key)
    table_heavy, table_light = split_heavy(table, heavy, key)
    return rows_heavy.join(F.broadcast(table_heavy), key).unionByName(rows_light.join(table_light, key))


def spread(rows: DataFrame, table: DataFrame, key: str, total: int, most: int = HEAVY) -> DataFrame:
    """Inner join with `table`, which has one row per key and in `n` (not returned) how many of the `total` rows have it.

    Fewer than `most` keys can have over total / most rows each: those are broadcast and their rows stay
    where they are, so no task gets all rows of one key. The others shuffle.
    """
    hot = F.col("n") > total / most
    few = table.where(hot)
    light = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few.drop("n")), key).unionByName(light.join(table.where(~hot).drop("n"), key))


def whole_keys(batches: Iterator[pa.RecordBatch], width: int, least: int = 50_000) -> Iterator[list[np.ndarray]]:
    """The first `width` columns of rows sorted by the first, in turns that end where a key ends, of `least` rows or more but for the last."""
    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(width)]
        cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))  # the last key may go on
        if count + cut >= least and (cut or held[-1][0][-1] != columns[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns], strict=True)]
            held, count, columns = [], 0, [c[cut:] for c in columns]
        held.append(columns)
        count += len(columns[0])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def buckets_for(rows: int, per_bucket: int = ROWS_PER_BUCKET, most: int = MOST_BUCKETS) -> int:
    return max(1, min(most, -(-rows // per_bucket)))


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str, rows: int, weight: Column | None = None) -> DataFrame:
    """Adds `name`: 0, 1, 2 ... within each of `groups` (or the sum of `weight` over the rows before).

    No window holds a whole group: rows are dealt by a hash of `order` into buckets, numbered inside them,
    and moved up by what the group's lower buckets hold. That small table has at most one row for each
    bucket and group; callers pass groups that are few. `df` is read twice: pass a written table.
    """
    many, one = buckets_for(rows), F.lit(1).cast("long") if weight is None else weight.cast("long")
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(many))).withColumn("_weight", one)
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*groups, "_bucket").agg(F.sum("_weight").alias("_sum")).select(*groups, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_inside", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    return inside.join(starts, [*groups, "_bucket"]).withColumn(name, F.col("_inside") + F.col("_start")).drop("_bucket", "_weight", "_inside", "_start")
