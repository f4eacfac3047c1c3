"""Near-dedup by shingle sets: SimHash fingerprints propose pairs, the hashed shingles of both texts decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import heavy_hitters, lookup, spread, text_or_empty, whole_keys, written
from quire.llm.components import components
from quire.llm.simhash import SEED, SHINGLES, Forest, U, _signed, block_masks, gray_rank, mixed, near_chunks, print_names
from quire.staging import discard

#: Pairs for each member that one group may propose in the first pass, besides those that connect it; GROWTH in the second, and times as many in each later one.
PER_MEMBER, GROWTH = 0, 8
#: What tells a row from others: its id, and 128 bits of its text.
MARKS = ("doc_id", "text_high", "text_low")
#: Bits in which a pair may differ in all fingerprints before its shingles are looked up: those expected at the least similarity and so many standard deviations more.
DEVIATIONS = 4.5
#: Sets from this size on differ as very large ones do.
LARGE = 64


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; words as in `fingerprint`."""
    tokens = text.lower().split()
    count = max(1, len(tokens) - words + 1) if tokens else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(tokens[i : i + words]), SEED) for i in range(count)), U, count))


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The hashes' lower halves, sorted, without repeats."""
    return np.unique(hashes.astype(np.uint32))


def set_prints(hashes: np.ndarray, rounds: int) -> np.ndarray:
    """`rounds` fingerprints of 64 majority bits over distinct hashes, as `fingerprint` has them over all shingles; 0 for no hashes.

    Each shingle counts once, as it does in the similarity, so the bits that differ follow the similarity
    however often a shingle is repeated.
    """
    ones = np.zeros((rounds, 64), np.int64)
    for at in range(0, len(hashes), SHINGLES):
        part = hashes[at : at + SHINGLES]
        for k in range(rounds):
            ones[k] += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            part = mixed(part)
    return np.packbits(2 * ones > len(hashes), axis=1).view(">u8").ravel().astype(U)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def differing(a: int, b: int, common: int) -> float:
    """The chance that a majority bit of two sets of `a` and `b` hashes differs, `common` of them being in both; a tie is 0."""
    half = lambda n: [math.comb(n, k) / 2**n for k in range(n + 1)]
    above = lambda own, all_, x: sum(p for k, p in enumerate(half(own)) if 2 * (x + k) > all_)
    total = 0.0
    for x, p in enumerate(half(common)):
        one, two = above(a - common, a, x), above(b - common, b, x)
        total += p * (one * (1 - two) + two * (1 - one))
    return total


@cache
def most_apart(least: float, bits: int) -> tuple[int, ...]:
    """Bits of `bits` in which two sets of similarity `least` or more differ at most, but for some three pairs in a million.

    By the size of the smaller set, up to LARGE, which stands for all larger ones: a bit differs with the angle
    between the sets' vectors, whose cosine is 2s / (1 + s) for sets of one size. In small sets ties make it
    likelier, so their chances are added up. An empty set is like no other.
    """
    shares = [0.0]
    for size in range(1, LARGE):
        others = [(size, other, math.ceil(least * (size + other) / (1 + least) - 1e-9)) for other in range(size, int(size / least + 1e-9) + 1)]
        shares.append(max((differing(*x) for x in others if x[2] <= size), default=0.0))
    shares.append(max(math.acos(2 * least / (1 + least)) / math.pi, shares[-1], shares[-2]))
    return tuple(math.ceil(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p))) for p in shares)


def _printed(batches: Iterator[pa.RecordBatch], words: int, rounds: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [x.as_py() for x in part.column(3)]
            hashes = [shingle_hashes(x, words) for x in texts]
            prints = np.array([set_prints(x, rounds) for x in hashes], U).reshape(-1, rounds).view(np.int64)
            sets = [shingle_set(x).tobytes() for x in hashes]
            # sets that are equal in 32 bits can differ in 64, so the fingerprints name the node as well
            nodes = [xxhash.xxh3_64_intdigest(s + p.tobytes()) for s, p in zip(sets, prints, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.array(nodes, U).view(np.int64)), *(pa.array(prints[:, k].copy()) for k in range(rounds)), pa.array(sets, pa.binary())], names=[*MARKS, "node", *print_names(rounds), "shingles"])


def _proposed(batches: Iterator[pa.RecordBatch], distance: int, per_member: int, least: float, rounds: int = 0) -> Iterator[pa.RecordBatch]:
    """Over rows (key, node, print, component, start, size, all `rounds` fingerprints) sorted by key: pairs (a, b), and of groups that have more the members (a, key, print, size, next) that go on.

    A group's pairs have a fixed order. From `start` on those between components are proposed, `per_member`
    for each member at most; where `start` is 0 also those that connect all the group's candidates. From the first
    pass (without `rounds`) only members of pairs that wait go on, and their pairs begin anew: a group grows with
    the corpus, and most of its members share no more than its block of bits. Pairs are
    looked at as they are found, so memory follows the members and not their pairs. Sets whose sizes differ so
    much that their similarity cannot reach `least` make no pair, nor do those too far apart in all fingerprints
    where rows have them.
    """
    limits = np.array(most_apart(least, 64 * rounds))
    for columns in whole_keys(batches, 6 + rounds):
        order = np.lexsort((columns[1], gray_rank(columns[2].view(U)), columns[0]))
        key, node, bits, component, start, size = (c[order] for c in columns[:6])
        prints = [c[order] for c in columns[6:]]
        lead = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[lead, len(key)])
        # pairs so far of each group, those of them that were open, and the first that has to wait
        seen, taken, later = np.zeros(len(lead), np.int64), np.zeros(len(lead), np.int64), np.full(len(lead), -1)
        waits = np.zeros(len(key), bool)
        forest = Forest(len(key))
        for a, b in near_chunks(bits.view(U), key, distance):
            group = np.searchsorted(lead, a, "right") - 1  # ascending, as a is
            place = seen[group] + np.arange(len(a)) - np.searchsorted(group, group, "left")
            seen += np.bincount(group, minlength=len(lead))
            possible = np.minimum(size[a], size[b]) / np.maximum(np.maximum(size[a], size[b]), 1) >= least
            open_ = (component[a] != component[b]) & (place >= start[a]) & possible
            a, b, group, place = a[open_], b[open_], group[open_], place[open_]
            if rounds:
                apart = np.zeros(len(a), np.int32)
                for own in prints:
                    apart += np.bitwise_count(own[a] ^ own[b])
                near = apart <= limits[np.minimum(np.minimum(size[a], size[b]), LARGE)]
                a, b, group, place = a[near], b[near], group[near], place[near]
            now = taken[group] + np.arange(len(a)) - np.searchsorted(group, group, "left") < per_member * sizes[group]
            taken += np.bincount(group, minlength=len(lead))
            fresh = np.flatnonzero(start[a] == 0)
            joins = np.zeros(len(a), bool)
            joins[fresh[forest.joining(a[fresh], b[fresh])]] = True
            late = np.flatnonzero(~now & (later[group] < 0))
            waiting, first = np.unique(group[late], return_index=True)
            later[waiting] = place[late[first]]
            waits[a[~now & ~joins]] = waits[b[~now & ~joins]] = True
            now |= joins
            yield _found(a=node[a[now]], b=node[b[now]])
        if rounds:
            more = np.flatnonzero(np.repeat(later >= 0, sizes))
            start = np.repeat(later, sizes)
        else:
            more = np.flatnonzero(waits)
            start = np.zeros(len(key), np.int64)
        yield _found(a=node[more], key=key[more], print=bits[more], size=size[more], next=start[more])


FOUND = ("a", "b", "key", "print", "size", "next")


def _found(**given: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(given[n], pa.int64()) if n in given else pa.nulls(len(given["a"]), pa.int64()) for n in FOUND], names=list(FOUND))


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = ([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(k)] for k in (2, 3))
        alike = np.array([jaccard(x, y) >= least for x, y in zip(*sides, strict=True)], bool)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(alike)) for k in (0, 1)], names=["a", "b"])


def _fresh(found: DataFrame, past: DataFrame | None) -> DataFrame:
    """The distinct pairs proposed, without those that an earlier pass has looked at."""
    pairs = found.where("key is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if past is None:
        return written(pairs.distinct(), "near-fresh")
    both = pairs.withColumn("old", F.lit(False)).unionByName(past.withColumn("old", F.lit(True)))
    return written(both.groupBy("a", "b").agg(F.max("old").alias("old")).where("not old").select("a", "b"), "near-fresh")


def _close(pairs: DataFrame, nodes: DataFrame, printed: DataFrame, apart: Column, most: Column, least: float) -> DataFrame:
    """Of the proposed pairs those whose shingle sets are alike, as links (a, b); the tables on the way go."""
    x, y = nodes.alias("x"), nodes.alias("y")
    close = written(pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(apart <= most).select("a", "b"), "near-close")
    wanted = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    sets = written(printed.select("node", "shingles").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "near-sets")
    both = close.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b").select("a", "b", "left", "right")
    links = written(both.mapInArrow(lambda it: _verified(it, least), "a long, b long"), "near-links")
    discard(close, sets)
    return links


def text_bits(text: Column) -> list[Column]:
    """text_high and text_low: 128 bits of a text, which tell rows with one id or none apart."""
    return [F.xxhash64(F.lit(1), text).alias(MARKS[1]), F.xxhash64(F.lit(2), text).alias(MARKS[2])]


def near_dedup(docs: DataFrame, words: int = 5, least: float = 0.8, rounds: int = 10, blocks: int = 5, distance: int = 12, id_col: str = "doc_id", text_col: str = "text", per_member: int = PER_MEMBER) -> DataFrame:
    """One row per input row: doc_id, text_high and text_low (128 bits of the text), component_id, kept.

    Two texts link when the Jaccard similarity of their sets of `words`-word shingles (as 32-bit hashes) is
    at least `least`. component_id is the least doc_id reachable by links (null only where no row of the
    component has an id), and `kept` marks the row that stays: of the least id, nulls last, then of the least
    bits of the text; rows alike in both are all marked. Words and empty texts are as in `simhash_dedup`. An
    empty table gives no rows. Every proposed link is verified, so nothing goes for a chance likeness of
    fingerprints.

    Pairs are proposed by `rounds` independent fingerprints: two that agree on one of `blocks` blocks of
    bits are searched together by the Gray index and proposed within `distance` bits. Texts with equal
    shingles are one node. Large groups of near copies would propose the square of their size: such a group
    proposes in passes, each of GROWTH times as many as the one before; what has been connected is not proposed
    again, and no pair is looked at twice. From the second pass on members bring all their fingerprints, and
    pairs too far apart in them (`most_apart`) are dropped where they are found. A table goes when its pass is done.
    """
    names = print_names(rounds)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_bits(text), text.cast("binary").alias("text"))
    schema = ", ".join([*(f"{n} long" for n in (*MARKS, "node", *names)), "shingles binary"])
    printed = written(rows.mapInArrow(lambda it: _printed(it, words, rounds), schema), "near-prints")
    mark = F.struct(F.col("doc_id").isNull().alias("unnamed"), *MARKS)
    nodes = written(printed.groupBy("node", (F.length("shingles") / 4).cast("int").alias("size"), *names).agg(F.min(mark).alias("least_mark")), "near-nodes")
    apart = sum((F.bit_count(F.col(f"x.{n}").bitwiseXOR(F.col(f"y.{n}"))) for n in names), F.lit(0))
    limit = F.element_at(F.lit(list(most_apart(least, 64 * rounds))), F.least("x.size", "y.size", F.lit(LARGE)) + 1)
    masks = list(enumerate(block_masks((1 << 64) - 1, blocks)))
    placed = None
    parts = [F.struct(F.xxhash64(F.lit(n), F.lit(k), F.col(n).bitwiseAND(F.lit(_signed(m)))).alias("key"), F.col(n).alias("print")) for n in names for k, m in masks]
    dealt = nodes.select("node", "size", F.explode(F.array(parts)).alias("by")).select("by.key", "node", "by.print", "size").withColumn("start", F.lit(0).cast("long"))
    most, past, brought = per_member, None, []
    while True:
        known = dealt if placed is None else dealt.join(placed, "node", "left")
        columns = known.select("key", "node", "print", F.coalesce("component", "node").alias("component") if placed is not None else F.col("node").alias("component"), "start", "size", *brought)
        ordered = columns.repartition("key").sortWithinPartitions("key")
        found = written(ordered.mapInArrow(partial(_proposed, distance=distance, per_member=most, least=least, rounds=len(brought)), ", ".join(f"{n} long" for n in FOUND)), "near-pairs")
        fresh = _fresh(found, past)
        past = fresh if past is None else past.unionByName(fresh)
        sure = _close(fresh, nodes, printed, apart, limit, least)
        # what is connected already is one link for each node
        stars = sure if placed is None else sure.unionByName(placed.select(F.col("node").alias("a"), F.col("component").alias("b")))
        before, placed = placed, written(components(stars), "near-components")
        discard(sure, *([before] if before else []))
        more = found.where("key is not null").select("key", F.col("a").alias("node"), "print", F.col("next").alias("start"), F.col("size").cast("int").alias("size"))
        if more.isEmpty():
            break
        # only the groups that have more go on
        brought = [f"all_{n}" for n in names]
        left = written(more.join(nodes.select("node", *(F.col(n).alias(b) for n, b in zip(names, brought, strict=True))), "node"), "near-crowded")
        discard(found, *([dealt] if most > per_member else []))
        dealt, most = left, GROWTH * max(most, 1)
    grouped = placed
    placed = written(nodes.select("node", "least_mark").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-placed")
    ids = written(printed.select(*MARKS, "node"), "near-ids")
    # the shingles are most of what has been written, and none is looked at any more
    discard(printed, nodes, found, grouped, *([dealt] if most > per_member else []))
    best = placed.groupBy("component").agg(F.min("least_mark").alias("best"), F.count(F.lit(1)).alias("n"))
    named = spread(placed, best, "component", placed.count()).groupBy("node").agg(F.min("best").alias("best"))
    heavy = written(heavy_hitters(ids, "node").select(F.col("node").cast("long").alias("node")), "near-heavy")
    return lookup(ids, named, heavy, "node").select(*MARKS, F.col("best.doc_id").alias("component_id"), (mark == F.col("best")).alias("kept"))
