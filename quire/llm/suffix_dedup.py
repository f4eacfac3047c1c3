"""Removal of byte strings that also start earlier, by suffix arrays of anchored contexts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered, spread, text_or_empty, written
from quire.llm.lyndon import suffix_array
from quire.staging import discard

#: Bytes hashed at once; positions in a piece fit the low bits of an anchor's rank.
PIECE_BITS = 20
#: Symbols that one suffix array is built over, unless one group alone is larger.
SYMBOLS = 60_000
#: Symbols of one anchor's contexts beyond which they are divided by more of the bytes around the anchor, and symbols for a task.
MOST_SYMBOLS, TASK_SYMBOLS = 60_000, 1_000_000
LAST = (1 << 63) - 1

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, U)
    filled, step = 1, U(base)
    while filled < count:
        more = min(filled, count - filled)
        out[filled : filled + more] = out[:more] * step
        filled, step = filled + more, step * step if filled * 2 < 1 << 40 else step
    return out


class Rolling:
    """Hashes of any substring of a piece of bytes from one running sum (arithmetic modulo 2**64)."""

    up = down = np.ones(0, U)

    def __init__(self, data: np.ndarray):
        if len(Rolling.up) <= len(data):
            size = max(len(data) + 1, 1 << PIECE_BITS) + 256
            with np.errstate(over="ignore"):
                Rolling.up, Rolling.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_TABLE[data] * Rolling.up[: len(data)], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        count = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:count]) * Rolling.down[:count]) if count > 0 else np.zeros(0, U)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * Rolling.down[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals of each owner; those that touch become one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    # ends never fall within an owner; a new owner starts lower, so owners are set apart by a running offset
    fresh = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    reach = np.concatenate([np.maximum.accumulate(part) for part in np.split(end, fresh[1:])]) if len(fresh) < len(owner) else end
    first = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])]
    at = np.flatnonzero(first)
    return owner[at], start[at], reach[np.r_[at[1:] - 1, len(owner) - 1]]


def anchored(data: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """Runs of starts of `length`-byte strings with one anchor: key, context hash, first start, starts, anchor's place in the first.

    The anchor of a string is its `core`-byte window of the smallest hash, the leftmost of equal ones. It
    depends on the string alone, so equal strings have equal anchors at equal places.
    """
    hashes = Rolling(data)
    keys = hashes.windows(core)
    low = U((1 << PIECE_BITS) - 1)
    ranked = (keys & ~low) | np.arange(len(keys), dtype=U)
    width, span = length - core + 1, 1
    while span * 2 <= width:
        ranked = np.minimum(ranked[:-span], ranked[span:])
        span *= 2
    if width > span:
        ranked = np.minimum(ranked[: len(ranked) - (width - span)], ranked[width - span :])
    anchor = (ranked & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, len(anchor)])
    anchor = anchor[first]
    place = anchor - first
    context = hashes.spans(first, first + count - 1 + length)
    context = (context & ~U(0xFFF)) | (count.astype(U) << U(6)) | place.astype(U)
    return keys[anchor].view(np.int64), context.view(np.int64), first, count, place


def pieces(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text that together hold each string of `length` bytes once."""
    step = (1 << PIECE_BITS) - length
    for at in range(0, max(1, len(data) - length + 1), step):
        yield at, data[at : at + step + length - 1]


def _runs(batches: Iterator[pa.RecordBatch], length: int, core: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0) of anchors, and spans (kind 1) of strings that start earlier in the same batch."""
    with np.errstate(over="ignore"):
        for batch in batches:
            ids, reps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            buffers = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(buffers.buffers()[1], np.int64)[buffers.offset : buffers.offset + len(buffers) + 1]
            data = np.frombuffer(buffers.buffers()[2] or b"", np.uint8)
            parts: list[tuple[np.ndarray, ...]] = []
            for row in range(len(ids)):
                text = data[offsets[row] : offsets[row + 1]]
                if len(text) < length:
                    continue
                for at, piece in pieces(text, length):
                    key, context, first, count, place = anchored(piece, length, core)
                    parts.append((key, context, np.full(len(key), ids[row]), first + at + (int(reps[row]) << 32), count, place))
            if not parts:
                continue
            key, context, doc, first, count, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((first, doc, context, key))
            key, context, doc, first, count, place = (x[order] for x in (key, context, doc, first, count, place))
            again = np.r_[False, (key[1:] == key[:-1]) & (context[1:] == context[:-1])]
            new = ~again
            shape = (count << 8 | place).astype(np.int32)
            yield _rows(0, key[new], context[new], doc[new], first[new], shape[new])
            owner, start, end = merged(doc[again], first[again], first[again] + count[again] - 1 + length)
            yield _rows(1, np.zeros(len(owner), np.int64), end, owner, start, np.zeros(len(owner), np.int32))


RUN = "kind int, key long, context long, doc long, first long, shape int"


def _rows(kind: int, key, context, doc, first, shape) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(context), pa.array(doc), pa.array(first), pa.array(shape, pa.int32())],
        names=["kind", "key", "context", "doc", "first", "shape"],
    )


def _grouped(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key, context, doc and first: spans of repeated contexts, and the first of each context of a key with several (kind 0)."""
    held = None  # the last row of the batch before: its key and context, the first row of that context, whether the key had others
    for batch in batches:
        if not batch.num_rows:
            continue
        key, context, doc, first, shape = (batch.column(k).to_numpy() for k in range(5))
        if held is not None:
            key, context, doc, first, shape = (np.concatenate([[h], x]) for h, x in zip(held[0], (key, context, doc, first, shape), strict=True))
        same_key = key[1:] == key[:-1]
        lead = np.r_[True, ~same_key | (context[1:] != context[:-1])]
        again = ~lead
        count = shape.astype(np.int64) >> 8
        owner, start, end = merged(doc[again], first[again], first[again] + count[again] - 1 + length)
        yield _rows(1, np.zeros(len(owner), np.int64), end, owner, start, np.zeros(len(owner), np.int32))
        at = np.flatnonzero(lead)
        k = key[at]
        joint = k[1:] == k[:-1]
        several = np.r_[False, joint] | np.r_[joint, False]
        known = held is not None and held[1]  # the held row went out already
        out = at[several & ~((at == 0) & known)] if known else at[several]
        yield _rows(0, key[out], context[out], doc[out], first[out], shape[out].astype(np.int32))
        last = at[-1]
        held = ([key[last], context[last], doc[last], first[last], shape[last]], bool(several[-1]) or (known and last == 0))


def _contexts(batches: Iterator[pa.RecordBatch], length: int, core: int) -> Iterator[pa.RecordBatch]:
    """The bytes on both sides of the anchor of each wanted run of a text."""
    for batch in batches:
        out: list[tuple] = []
        for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = text.as_py()
            for run in wanted:
                at, place = run["first"] & 0xFFFFFFFF, run["shape"] & 0xFF
                end = at + (run["shape"] >> 8) - 1 + length
                out.append((run["key"], doc, run["first"], run["shape"], data[at : at + place] + data[at + place + core : end]))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())], names=["key", "doc", "first", "shape", "sides"])


def repeated_starts(key: np.ndarray, doc: np.ndarray, first: np.ndarray, shape: np.ndarray, sides: list[bytes], length: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of each string that also starts earlier among these contexts; all contexts of a key are here.

    The anchor's bytes, the same for all contexts of a key, stand as one symbol of their own, so a string is
    `length - core + 1` symbols. The suffix array of all contexts puts equal strings side by side, and
    neighbours are compared symbol by symbol.
    """
    width = length - core
    count, gap = shape.astype(np.int64) >> 8, shape.astype(np.int64) & 0xFF
    sizes = count - 1 + width
    # the bytes shifted up by two, the anchor above all bytes, 1 between contexts
    _, letter = np.unique(key, return_inverse=True)
    symbols = np.ones(int(sizes.sum()) + 2 * len(key), np.int64)
    begin = np.cumsum(sizes + 2) - sizes - 2
    own, step = _steps(sizes)
    symbols[begin[own] + step + (step >= gap[own])] = np.frombuffer(b"".join(sides), np.uint8).astype(np.int64) + 2
    symbols[begin + gap] = 258 + letter
    wanted = np.full(len(symbols), -1, np.int64)
    own, step = _steps(count)
    wanted[begin[own] + step] = np.arange(len(own))
    order = np.array(suffix_array(symbols), np.int64)
    order = order[wanted[order] >= 0]
    alike = np.ones(len(order) - 1, bool)
    for k in range(width + 1):
        alike &= symbols[order[1:] + k] == symbols[order[:-1] + k]
    classes = np.cumsum(np.r_[True, ~alike])
    which = wanted[order]
    docs = doc[own][which]
    at = first[own][which] + step[which]
    rank = np.lexsort((at, docs, classes))
    later = rank[np.r_[False, classes[rank][1:] == classes[rank][:-1]]]
    return docs[later], at[later]


def _steps(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of these sizes, laid end to end: each place's item, and its place within it."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _resolved(batches: Iterator[pa.RecordBatch], length: int, core: int) -> Iterator[pa.RecordBatch]:
    """Over contexts sorted by key: spans of strings that start earlier."""
    held: list[tuple] = []
    held_symbols = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        key, doc, first, shape = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        with np.errstate(over="ignore"):
            docs, at = repeated_starts(key, doc, first, shape, [r[4] for r in rows], length, core)
        owner, start, end = merged(docs, at, at + length)
        return _rows(1, np.zeros(len(owner), np.int64), end, owner, start, np.zeros(len(owner), np.int32))

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if held and held_symbols > 4 * SYMBOLS and held[-1][0] != row[0]:
                yield flush(held)
                held, held_symbols = [], 0
            held.append(row)
            held_symbols += len(row[4]) + 2
    if held:
        yield flush(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    for batch in batches:
        rows = []
        for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = text.as_py()
            kept, runs, at = data, [], 0
            if found:
                start, end = np.array([(x["first"] & 0xFFFFFFFF, x["end"] & 0xFFFFFFFF) for x in found], np.int64).T
                _, start, end = merged(np.zeros(len(start), np.int64), start, end)
                left = []
                for a, z in zip(start.tolist(), end.tolist(), strict=True):
                    left.append(data[at:a])
                    runs.append({"start": a, "end": z})
                    at = z
                kept = b"".join([*left, data[at:]])
            rows.append((doc, len(data), len(data) - len(kept), len(runs), runs, kept))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """`id` (null ids last), `rep` (0 unless an id repeats), `doc_id`, `text` as bytes, and the columns `carry` in a struct `_carried`.

    Rows that repeat an id are numbered by digests of their texts alone, in buckets (`numbered`): an id, or
    no id, that a third of all rows has fills no task.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"), *([F.struct(*carry).alias("_carried")] if carry else []))
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows.withColumn("rep", F.lit(0))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "suffix-texts")
    marks = written(rows.select("id", "_row", F.sha2("text", 256).alias("_digest")), "suffix-marks")
    reps = numbered(marks, ["id"], ["_digest"], "rep", marks.count()).select("_row", F.col("rep").cast("int"))
    return rows.join(reps, "_row").drop("_row")


def repeated_spans(texts: DataFrame, length: int = 100, core: int = 48, most_symbols: int = MOST_SYMBOLS) -> DataFrame:
    """`doc`, `first`, `end` of byte spans covered by `length`-byte strings that also start earlier (positions as rep << 32 | byte)."""
    runs = written(texts.select("id", "rep", "text").mapInArrow(lambda it: _runs(it, length, core), RUN), "suffix-runs")
    columns = ["key", "context", "doc", "first", "shape"]
    dealt = runs.where("kind = 0").select(*columns).repartition("key").sortWithinPartitions("key", "context", "doc", "first")
    grouped = written(dealt.mapInArrow(lambda it: _grouped(it, length), RUN), "suffix-groups")
    # the anchors are most of what has been written, and of them only those in `grouped` are looked at any more
    anchors, runs = runs, written(runs.where("kind = 1"), "suffix-spans")
    discard(anchors)
    spans = [frame.where("kind = 1").select("doc", "first", F.col("context").alias("end")) for frame in (runs, grouped)]
    wanted = grouped.where("kind = 0").groupBy("doc", F.shiftright("first", 32).cast("int").alias("rep")).agg(F.collect_list(F.struct("key", "first", "shape")).alias("wanted"))
    source = texts.select(F.col("id").alias("doc"), "rep", "text").join(wanted, ["doc", "rep"]).select("doc", "text", "wanted")
    contexts = written(source.mapInArrow(lambda it: _contexts(it, length, core), "key long, doc long, first long, shape int, sides binary"), "suffix-contexts")
    contexts = contexts.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - core))
    small, symbols = [], 0
    while True:
        sizes = written(contexts.groupBy("key").agg(F.sum(F.length("sides") + 2).alias("symbols"), F.count(F.lit(1)).alias("n")), "suffix-sizes")
        total = sizes.agg(F.sum("n").alias("n"), F.sum("symbols").alias("symbols")).first()
        symbols += total["symbols"] or 0
        large = F.col("symbols") > most_symbols
        if sizes.where(large).isEmpty():
            small.append(contexts)
            break
        sized = spread(contexts, sizes, "key", total["n"])
        small.append(sized.where(~large).drop("symbols"))
        contexts, again = _divided(sized.where(large).drop("symbols"), length, core)
        spans.append(again)
    few = reduce(DataFrame.unionByName, small).drop("low", "high")
    sorted_contexts = few.repartition(1 + symbols // TASK_SYMBOLS, "key").sortWithinPartitions("key", "doc", "first")
    resolved = written(sorted_contexts.mapInArrow(lambda it: _resolved(it, length, core), RUN), "suffix-resolved")
    spans.append(resolved.select("doc", "first", F.col("context").alias("end")))
    return reduce(DataFrame.unionByName, spans)


def _divided(contexts: DataFrame, length: int, core: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of anchors that have too many for one task, dealt out by more bytes; and the spans of those that repeat another.

    `low` and `high` bound how many bytes before the anchor a string of the group starts. Strings that start
    at least halfway share the bytes just before the anchor up to there, and the others share bytes behind
    it, so either part of a context goes to a key of its own, narrower by half; equal strings go together.
    Of parts that are equal in all bytes the earliest goes on, so when `low` meets `high` one is left.
    """
    width = length - core
    place, count = F.col("shape").bitwiseAND(F.lit(255)), F.shiftright("shape", 8)
    middle = F.floor((F.col("low") + F.col("high") + 1) / 2).cast("int")
    skipped = F.greatest(F.lit(0), place - middle + 1)  # starts of the upper part
    upper = F.struct(
        F.xxhash64("key", F.lit(1), F.substring("sides", place - middle + 1, middle)).alias("key"),
        F.col("first").alias("first"),
        F.least(count, place - middle + 1).alias("count"),
        place.alias("place"),
        F.substring("sides", F.lit(1), F.least(count, place - middle + 1) - 1 + width).alias("sides"),
        middle.alias("low"),
        F.col("high").alias("high"),
    )
    lower = F.struct(
        F.xxhash64("key", F.lit(0), F.substring("sides", place + 1, width - middle + 1)).alias("key"),
        (F.col("first") + skipped).alias("first"),
        (count - skipped).alias("count"),
        (place - skipped).alias("place"),
        F.substring("sides", skipped + 1, F.length("sides")).alias("sides"),
        F.col("low").alias("low"),
        (middle - 1).alias("high"),
    )
    parts = F.filter(F.array(upper, lower), lambda p: (p["count"] > 0) & (p["low"] <= p["high"]))
    rows = contexts.select("doc", F.explode(parts).alias("part")).select("doc", "part.*")
    rows = rows.select("key", "doc", "first", (F.shiftleft("count", 8) + F.col("place")).alias("shape"), "sides", "low", "high")
    rows = written(rows.withColumn("string", F.sha2(F.concat_ws("/", F.hex("sides"), "key", "shape").cast("binary"), 256)), "suffix-divided")
    earliest = rows.groupBy("string").agg(F.min(F.struct("doc", "first")).alias("earliest"), F.count(F.lit(1)).alias("n"))
    known = written(spread(rows, earliest, "string", rows.count()).withColumn("is_first", F.struct("doc", "first") == F.col("earliest")).drop("earliest", "string"), "suffix-known")
    again = known.where("not is_first").select("doc", "first", (F.col("first") + F.shiftright("shape", 8) - 1 + length).alias("end"))
    return known.where("is_first").drop("is_first"), again


def suffix_dedup(docs: DataFrame, length: int = 100, core: int = 48, id_col: str = "doc_id", text_col: str = "text", most_symbols: int = MOST_SYMBOLS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, spans (start, end), kept (the bytes left).

    A byte goes when a string of `length` bytes that covers it also starts earlier in the corpus: in a
    document of smaller id, or earlier in the same one. Texts are UTF-8 bytes, whole; a null text is empty, a
    text shorter than `length` loses nothing, and a run of one byte keeps its first `length` bytes. Strings
    are judged on the input. Null ids come last; rows that repeat an id come in the order of their texts'
    digests, each one a text of its own. An empty table gives no rows.

    Every string has an anchor, the window of `core` bytes with the smallest hash, so equal strings share an
    anchor and only the contexts of anchors that occur with different surroundings are compared. Equal
    contexts are merged in each batch and again after the shuffle, so hot passages travel as a few rows.
    The rest are ordered by the suffix arrays (linear grouping) of the contexts of their anchors; an anchor
    whose contexts are too many for one task is divided by more of the bytes around it.
    """
    texts = keyed(docs, id_col, text_col)
    spans = repeated_spans(texts, length, core, most_symbols)
    per_text = spans.groupBy(F.col("doc").alias("id"), F.shiftright("first", 32).cast("int").alias("rep")).agg(F.collect_list(F.struct("first", "end")).alias("found"))
    joined = texts.join(per_text, ["id", "rep"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
