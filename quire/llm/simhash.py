"""SimHash near-dedup: a Gray-order hierarchical index finds the fingerprints that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import heavy_hitters, lookup, spread, text_or_empty, whole_keys, written
from quire.llm.components import components

U = np.uint64
SEED = 42
#: Shingles counted at once, children of a node of the index, and (query, node) pairs compared at once.
SHINGLES, FAN_OUT, FRONTIER = 1 << 16, 8, 1 << 20
#: Fingerprints that share a block beyond which their other bits are cut into blocks as well.
MOST_IN_BLOCK = 20_000
#: Times that crowded blocks are cut, at most.
DEEPEST = 4


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same things, one for each."""
    with np.errstate(over="ignore"):
        hashes = hashes * U(0x9E3779B97F4A7C15) + U(0xD1B54A32D192ED03)
        hashes = (hashes ^ (hashes >> U(31))) * U(0xBF58476D1CE4E5B9)
        return hashes ^ (hashes >> U(29))


def fingerprint(text: bytes, words: int = 3, rounds: int = 1) -> list[int]:
    """64 majority bits over the XXH64 of all shingles (repeats included); 0 without words.

    Further rounds give fingerprints of their own, from the same hashes mixed anew.
    """
    tokens = text.lower().split()  # of bytes: A-Z only, blanks are space and tab to carriage return
    if not tokens:
        return [0] * rounds
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    joined = b" ".join(tokens)
    starts = np.cumsum(lengths + 1) - lengths - 1
    count = max(1, len(tokens) - words + 1)
    first = starts[:count].tolist()
    last = (starts + lengths)[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((rounds, 64), np.int64)
    for at in range(0, count, SHINGLES):
        hashes = np.array([digest(joined[a:z], SEED) for a, z in zip(first[at : at + SHINGLES], last[at : at + SHINGLES], strict=True)], U)
        for k in range(rounds):
            ones[k] += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            if k + 1 < rounds:
                hashes = mixed(hashes)
    return [int.from_bytes(np.packbits(2 * row > count).tobytes(), "big") for row in ones]


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, rounds: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py(), words, rounds) for x in batch.column(1)], U).reshape(-1, rounds).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(prints[:, k].copy()) for k in range(rounds))], names=["doc_id", *print_names(rounds)])


def print_names(rounds: int) -> list[str]:
    return ["print", *(f"print{k}" for k in range(1, rounds))]


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """doc_id, print (the fingerprint's 64 bits as a signed long), and print1, print2 ... of further rounds."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, words, rounds), ", ".join(["doc_id long", *(f"{name} long" for name in print_names(rounds))]))


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order: neighbours there differ in one bit."""
    rank = prints.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U(step)
    return rank


def near_chunks(prints: np.ndarray, group: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i < j, in order) of fingerprints of one group that differ in at most `distance` bits, some `FRONTIER` at a time.

    `prints` come sorted by group and Gray rank. Runs of `FAN_OUT` neighbours form a node with the bits all
    of them share (mask and pattern); nodes form upper nodes the same way, within their group. A query goes
    down from its group's top nodes and drops a node, with all below it, once the shared bits it differs in
    are too many; shared bits only grow downwards, so nothing within `distance` is lost.
    """
    levels = [(np.full(len(prints), ~U(0)), prints, np.arange(len(prints)), np.arange(len(prints)) + 1)]
    owner = group
    while True:
        mask, pattern, _, _ = levels[-1]
        lead = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[lead, len(owner)])
        if sizes.max() <= FAN_OUT:
            break
        inside = np.arange(len(owner)) - np.repeat(lead, sizes)
        at = np.flatnonzero(inside % FAN_OUT == 0)
        shared = np.bitwise_and.reduceat(mask, at) & ~(np.bitwise_or.reduceat(pattern, at) ^ np.bitwise_and.reduceat(pattern, at))
        levels.append((shared, pattern[at], at, np.r_[at[1:], len(owner)]))
        owner = owner[at]
    # the top nodes of a group, and its members as queries
    top = np.searchsorted(owner, group, "left"), np.searchsorted(owner, group, "right")
    stack = [(len(levels) - 1, np.arange(len(prints)), *top)]
    while stack:
        level, query, low, high = stack.pop()
        sizes = high - low
        total = int(sizes.sum())
        if total > FRONTIER and len(query) > 1:
            half = len(query) // 2
            stack += [(level, query[half:], low[half:], high[half:]), (level, query[:half], low[:half], high[:half])]
            continue
        query = np.repeat(query, sizes)
        node = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        mask, pattern, first, end = levels[level]
        near = np.bitwise_count((prints[query] ^ pattern[node]) & mask[node]) <= distance
        query, node = query[near], node[near]
        if level:
            stack.append((level - 1, query, first[node], end[node]))
        else:
            ordered = query < node
            yield query[ordered], node[ordered]


class Forest:
    """Trees over `count` nodes; of links taken in turn only those are kept that join two trees, as few as connect the same."""

    def __init__(self, count: int):
        self.root = np.arange(count)

    def joining(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the links kept, which join their trees from now on."""
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        between = np.flatnonzero(self.root[a] != self.root[b])
        if not len(between):
            return between
        root, kept = self.root.tolist(), []
        for k, x, y in zip(between.tolist(), a[between].tolist(), b[between].tolist(), strict=True):
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[y] = x
                kept.append(k)
        self.root = np.array(root)
        return np.array(kept, np.int64)


def _linked(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Over rows (key, print) sorted by key: links of near fingerprints, a forest for each run of keys.

    Pairs are thinned as they are found, so memory follows the fingerprints and not their pairs.
    """
    for key, bits in whole_keys(batches, 2):
        prints = bits.view(U)
        order = np.lexsort((gray_rank(prints), key))
        key, prints = key[order], prints[order]
        forest = Forest(len(prints))
        for a, b in near_chunks(prints, key, distance):
            kept = forest.joining(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(prints[x[kept]].view(np.int64)) for x in (a, b)], names=["a", "b"])


def block_masks(bits: int, blocks: int) -> list[int]:
    """`blocks` masks that divide the bits set in `bits` into near equal parts, from the lowest."""
    places = [k for k in range(64) if bits >> k & 1]
    edges = [round(len(places) * k / blocks) for k in range(blocks + 1)]
    return [sum(1 << k for k in places[a:z]) for a, z in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(prints: DataFrame, distance: int = 2, most_in_block: int = MOST_IN_BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `print`, enough to connect all that differ in at most `distance` bits.

    Two fingerprints within `distance` agree on one of `distance + 1` blocks of bits, so each is dealt once
    for each block; those that agree on a block are indexed and searched together. Where too many do, their
    other bits are cut into blocks the same way, and again, so what one task indexes stays small without
    losing a pair: with a distance of 2 four cuts leave 14 bits free, fewer values than fill a block.
    """
    bits = F.col("print")
    rows, free = prints.select("print", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key")), [(1 << 64) - 1]
    total, links = (distance + 1) * prints.count(), []
    for depth in range(DEEPEST):
        cases, left = [], []
        for path, own in enumerate(free):
            for mask in block_masks(own, distance + 1):
                value = F.xxhash64("key", F.lit(len(left)), bits.bitwiseAND(F.lit(_signed(mask))))
                cases.append(F.when(F.col("path") == path, F.struct(F.lit(len(left)).alias("path"), value.alias("key"))))
                left.append(own & ~mask)
        dealt = rows.select("print", F.explode(F.array_compact(F.array(cases))).alias("by")).select("print", "by.*")
        counts = written(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("many", F.col("n")), "simhash-counts")
        last = depth + 1 == DEEPEST or counts.where(F.col("many") > most_in_block).isEmpty()
        shared = spread(dealt, counts, "key", total)
        here = (shared if last else shared.where(F.col("many") <= most_in_block)).select("key", "print").repartition("key").sortWithinPartitions("key")
        links.append(written(here.mapInArrow(lambda it: _linked(it, distance), "a long, b long"), "simhash-links"))
        if last:
            break
        rows, free = written(shared.where(F.col("many") > most_in_block).drop("many"), "simhash-crowded"), left
        total = (distance + 1) * rows.count()
    return reduce(DataFrame.unionByName, links)


def node_links(nodes: DataFrame, name: str, distance: int, most_in_block: int) -> DataFrame:
    """Links (a, b) between `node`s: those of one value of the fingerprint `name` with the least of them, and the least ones of near values."""
    least = written(nodes.groupBy(name).agg(F.min("node").alias("least")), "simhash-least")
    near = near_links(least.select(F.col(name).alias("print")), distance, most_in_block)
    ends = least.select(F.col(name).alias("a"), F.col("least").alias("x")), least.select(F.col(name).alias("b"), F.col("least").alias("y"))
    across = near.join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return nodes.join(least, name).select(F.col("node").alias("a"), F.col("least").alias("b")).where("a <> b").unionByName(across)


def simhash_dedup(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", most_in_block: int = MOST_IN_BLOCK, rounds: int = 1) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), kept.

    Texts are compared as lower-cased (A-Z) words in shingles of `words`; shorter texts are one shingle, and
    texts without words, null ones included, share the fingerprint zero. Documents link when fingerprints
    differ in at most `distance` bits, and `kept` marks the least doc_id of each component. With more
    `rounds` each document has as many independent fingerprints and one near pair of them is enough: what
    a single fingerprint misses by chance another finds. A null doc_id names no component while others do;
    rows that repeat an id are alike. An empty table gives no rows.

    Documents with equal fingerprints are one node, so copies are never paired; the links between nodes are
    found by `near_links` and followed by `components`.
    """
    names = print_names(rounds)
    printed = fingerprints(docs, words, id_col, text_col, rounds)
    printed = written(printed.withColumn("node", F.xxhash64(*names) if rounds > 1 else F.col("print")), "simhash-prints")
    nodes = written(printed.groupBy("node", *names).agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    if rounds > 1:
        links = node_links(nodes, names[0], distance, most_in_block)
        for name in names[1:]:
            links = links.unionByName(node_links(nodes, name, distance, most_in_block))
    else:
        links = near_links(nodes.select("print"), distance, most_in_block)
    placed = written(nodes.select("node", "least_id").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")), "simhash-placed")
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = spread(placed, least, "component", placed.count()).select("node", "component_id").distinct()
    heavy = written(heavy_hitters(printed, "node").select(F.col("node").cast("long").alias("node")), "simhash-heavy")
    found = lookup(printed, named, heavy, "node")
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
