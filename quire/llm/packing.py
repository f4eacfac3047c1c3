"""Packing of token ids into windows: a non-negative least squares plan over the histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered, written
from quire.llm.tokens import word_ids

#: Sweeps of the solver; combinations tried for each length; frequent lengths they are made with.
SWEEPS, PER_LENGTH, FREQUENT = 40, 4, 64

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def combinations(counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Two or three lengths that fill the window: all pairs, and for each length the triples best supplied."""
    present = np.flatnonzero(counts)
    pairs = [(int(window - a), int(a)) for a in present if a <= window - a and counts[window - a]]
    frequent = present[np.argsort(-counts[present], kind="stable")][:FREQUENT]
    triples = set()
    for a in present.tolist():
        rest = window - a - frequent
        fits = frequent[(rest > 0)]
        fits = fits[counts[window - a - fits] > 0]
        supply = np.minimum(counts[fits], counts[window - a - fits])
        for b in fits[np.argsort(-supply, kind="stable")][:PER_LENGTH].tolist():
            triples.add(tuple(sorted((a, b, window - a - b), reverse=True)))
    return pairs + sorted(triples, reverse=True)


def solved(combos: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares: how often to repeat each combination so that its lengths use up `counts`.

    Coordinate descent: each repeat count in turn takes the value that is best with the others held, or 0.
    """
    left = counts.astype(float).tolist()
    repeats = [0.0] * len(combos)
    uses = [tuple((length, combo.count(length)) for length in dict.fromkeys(combo)) for combo in combos]
    for _ in range(sweeps):
        moved = 0.0
        for k, use in enumerate(uses):
            step = max(-repeats[k], sum(n * left[length] for length, n in use) / sum(n * n for _, n in use))
            if step:
                repeats[k] += step
                moved = max(moved, abs(step))
                for length, n in use:
                    left[length] -= n * step
        if moved < 0.25:
            break
    return np.array(repeats)


class Plan:
    """Where the k-th remainder of each length goes.

    `key` (length, then first k), sorted; beside it `sequence` and `offset` for the first k, and `laid`:
    whether the next k stands behind it in the same row of windows rather than in a window of its own.
    """

    def __init__(self, histogram: Mapping[int, int], window: int, first: int = 0):
        counts = np.zeros(window, np.int64)
        for length, n in histogram.items():
            counts[length] = n
        combos = combinations(counts, window)
        repeats = solved(combos, counts)
        left, used = counts.copy(), np.zeros(window, np.int64)
        rows: list[tuple[int, int, int, int, bool]] = []
        sequence = first
        # the rounded counts first, then whatever more of each combination the rest still fills exactly
        for greedy in (False, True):
            for k in np.argsort(-repeats, kind="stable").tolist():
                combo = combos[k]
                most = min(int(left[length]) // combo.count(length) for length in combo)
                times = most if greedy else min(most, int(repeats[k]))
                if times > 0:
                    offset = 0
                    for length in combo:
                        rows.append((length, int(used[length]), sequence, offset, False))
                        used[length] += times
                        left[length] -= times
                        offset += length
                    sequence += times
        self.exact = sequence - first
        # the residue end to end, longest first: a window is filled to the brim and the piece cut there
        self.base, at = sequence, 0
        for length in np.flatnonzero(left)[::-1].tolist():
            rows.append((length, int(used[length]), sequence + at // window, at % window, True))
            at += length * int(left[length])
        self.sequences = sequence + -(-at // window)
        self.window = window
        rows.sort()
        length, start, self.sequence, self.offset, self.laid = (np.array([r[k] for r in rows], bool if k == 4 else np.int64) for k in range(5))
        self.start, self.key = start, length << 44 | start

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the first id of each remainder."""
        at = np.searchsorted(self.key, length << 44 | rank, "right") - 1
        along = rank - self.start[at]
        inside = self.offset[at] + np.where(self.laid[at], along * length, 0)
        return self.sequence[at] + np.where(self.laid[at], inside // self.window, along), inside % self.window


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int) -> Iterator[pa.RecordBatch]:
    words = word_ids(vocabulary)
    kind = np.dtype("<u2") if words.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else np.dtype("<u4")
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            ids = words.encode(part.column(1).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([np.append(x, end).astype(kind).tobytes() for x in ids], pa.binary()), pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array(np.full(len(ids), kind.itemsize, np.int32))],
                names=["doc_id", "ids", "doc_tokens", "width"],
            )


def tokenized(docs: DataFrame, vocabulary: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian, `width` bytes each), doc_tokens: every whole text's ids, then `end`. A null text has `end` alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encoded(it, vocabulary, end), "doc_id long, ids binary, doc_tokens long, width int")


def _pieces(batches: Iterator[pa.RecordBatch], plan: Plan, window: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PIECE.split(", ")]
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            part = batch.slice(begin, 1000)
            docs, total = part.column(0).to_pylist(), part.column(2).to_numpy()
            full_start, rank = part.column(4).fill_null(0).to_numpy(), part.column(5).fill_null(0).to_numpy()
            rest = total % window
            has = rest > 0
            sequence, offset = np.zeros(len(total), np.int64), np.zeros(len(total), np.int64)
            sequence[has], offset[has] = plan.place(rest[has], rank[has])
            out: list[tuple] = []
            for k, (doc, count, width) in enumerate(zip(docs, total.tolist(), part.column(3).to_pylist(), strict=True)):
                ids = np.frombuffer(part.column(1)[k].as_buffer(), f"<u{width}").astype("<u4")
                spans = [(at, window, int(full_start[k]) + at // window, 0) for at in range(0, count - window + 1, window)]
                if has[k]:
                    at, room = count - int(rest[k]), window - int(offset[k])
                    spans.append((at, min(room, count - at), int(sequence[k]), int(offset[k])))
                    if count - at > room:
                        spans.append((at + room, count - at - room, int(sequence[k]) + 1, 0))
                out += [(doc, at, n, ids[at : at + n].tobytes(), count, s, o) for at, n, s, o in spans]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(columns)], names=names)


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every text's ids and the id `end` are put into sequences of `window` tokens. A text gives as many whole
    windows as it fills; its remainder goes by a plan over the histogram of remainders, which has at most
    `window - 1` lengths whatever the corpus: combinations of two or three lengths that fill a window
    exactly, repeated as a non-negative least squares solution says (rounded down), then as often as the
    rest still allows; what is left is laid end to end, longest first, cut where a window is full. So every
    window but the last is full, and only residual pieces are cut. A remainder's place follows from its
    length and its number among those of that length; numbers are dealt by buckets, never in one task.

    A null text counts as empty and has the id `end` alone. Rows that repeat an id are packed once each; null
    ids are kept. An empty table gives no rows.
    """
    rows = written(tokenized(docs, vocabulary, end, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "pack-ids")
    lengths = rows.select("doc_id", "_row", "doc_tokens", (F.col("doc_tokens") % window).alias("rest"), F.floor(F.col("doc_tokens") / window).alias("full"))
    whole = lengths.where("full > 0")
    sizes = lengths.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("windows"), F.count_if(F.col("full") > 0).alias("whole"), F.count_if(F.col("rest") > 0).alias("rests")).first()
    histogram = {r["rest"]: r["n"] for r in lengths.where("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}  # fewer than `window` rows
    plan = Plan(histogram, window, sizes["windows"])
    order = ["doc_id", "_row"]
    ranks = numbered(lengths.where("rest > 0"), ["rest"], order, "rank", sizes["rests"]).select("_row", "rank")
    starts = numbered(whole, [], order, "full_start", sizes["whole"], F.col("full")).select("_row", "full_start")
    places = ranks.join(starts, "_row", "full")
    joined = rows.join(places.hint("shuffle_hash"), "_row", "left").select("doc_id", "ids", "doc_tokens", "width", "full_start", "rank")
    return joined.mapInArrow(lambda it: _pieces(it, plan, window), PIECE)


def sequences(pieces: DataFrame, window: int = 2048, pad: int = 0) -> DataFrame:
    """sequence_id, ids (padded to `window`), n_tokens, doc_ids: the pieces of each sequence in order."""
    filler = F.lit(pad.to_bytes(4, "little"))
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids", "length")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return (
        pieces.groupBy("sequence_id")
        .agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
        .select("sequence_id", F.concat(joined, F.aggregate(F.sequence(F.lit(1), F.lit(window)), F.lit(b""), lambda a, x: F.when(x > F.col("n_tokens"), F.concat(a, filler)).otherwise(a))).alias("ids"), "n_tokens", F.col("parts.doc_id").alias("doc_ids"))
    )
