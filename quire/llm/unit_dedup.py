"""Substring dedup by hashes of lines, paragraphs or sentences, and of passages cut where their words say."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import carried
from quire.llm.suffix_dedup import keyed

#: What stands between two units of a kind. Sentences end within lines; lines are cut into them.
BETWEEN = {"line": re.compile(r"\n+"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*"), "sentence": re.compile(r"(?<=[.!?])[ \t]+|\n+")}

#: Positions of which one at least is a cut, if all of them are in a passage; words of a passage at least.
WINDOW, PASSAGE = 7, 16
#: Among a unit's numbers, those of whole lines and of passages.
LINES, PASSAGES, NUMBER = 1 << 30, 2 << 30, (1 << 30) - 1

WORD = re.compile(r"\S+")
RESULT = ("doc_id", "n_units", "n_repeated", "spans", "kept")
UNIT = "kind int, high long, low long, doc long, unit long"


def units(text: str, kind: str) -> list[tuple[int, int]]:
    """Start and end (code points) of each unit; together with what stands between them they are the text."""
    found, at = [], 0
    for gap in BETWEEN[kind].finditer(text):
        if gap.start() > at:
            found.append((at, gap.start()))
        at = gap.end()
    if at < len(text):
        found.append((at, len(text)))
    return found


def digest(unit: str, seed: int = 0) -> bytes:
    """128 bits of the unit in lower case, its words a space apart; empty for a unit without a word."""
    words = unit.lower().split()
    return xxhash.xxh3_128_digest(" ".join(words), seed) if words else b""


def text_words(text: str) -> list[bytes]:
    return " ".join(text.lower().split()).encode().split(b" ")


def passages(words: list[bytes], least: int = PASSAGE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each passage: from a cut to the first cut, or the text's end, that is `least` words on.

    A cut is where the hash of two words is the least of any `window` neighbours (the last one if equal), so
    cuts depend on the words around alone, and equal passages have equal cuts but for `window` words at
    either border: of a shared run of `least` + 4 * `window` - 2 words one passage at least is found.
    """
    if len(words) < max(least, window + 1):
        return (np.zeros(0, np.int64),) * 2
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    pairs ^= pairs >> np.uint64(31)
    views = np.lib.stride_tricks.sliding_window_view(pairs, window)
    cuts = np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))
    first = cuts[cuts + least <= len(words)]
    return first, np.r_[cuts, len(words)][np.searchsorted(cuts, first + least)]


def _passage_digests(text: str) -> Iterator[tuple[int, bytes]]:
    """Number and digest (128 bits) of each passage, without those that overlap an equal one of the text."""
    words = text_words(text)
    ends: dict[bytes, int] = {}
    for k, (a, z) in enumerate(zip(*(x.tolist() for x in passages(words)), strict=True)):
        name = xxhash.xxh3_128_digest(b" ".join(words[a:z]), 2)
        if ends.get(name, 0) <= a:
            ends[name] = z
            yield k, name


def _digested(batches: Iterator[pa.RecordBatch], kind: str, whole: bool) -> Iterator[pa.RecordBatch]:
    """The first unit of each digest in a batch (kind 0), and those that repeat one of the batch (kind 1)."""
    for batch in batches:
        hashes: list[bytes] = []
        docs, places = [], []
        for doc, rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = text.as_py().decode()
            for k, (a, z) in enumerate(units(text, kind)):
                if name := digest(text[a:z]):
                    hashes.append(name)
                    docs.append(doc)
                    places.append(rep << 32 | k)
            if whole:
                found = [(LINES | k, digest(text[a:z], 1)) for k, (a, z) in enumerate(units(text, "line") if kind != "line" else ())]
                found += [(PASSAGES | k, name) for k, name in _passage_digests(text)]
                for k, name in found:
                    if name:
                        hashes.append(name)
                        docs.append(doc)
                        places.append(rep << 32 | k)
        names = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
        doc, place = np.array(docs, np.int64), np.array(places, np.int64)
        order = np.lexsort((place, doc, names[:, 1], names[:, 0]))
        high, low, doc, place = names[order, 0], names[order, 1], doc[order], place[order]
        again = np.r_[False, (high[1:] == high[:-1]) & (low[1:] == low[:-1])] if len(doc) else np.zeros(0, bool)
        yield _units(again.astype(np.int32), high, low, doc, place)


def _units(kind, high, low, doc, unit) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(high), pa.array(low), pa.array(doc), pa.array(unit)], names=["kind", "high", "low", "doc", "unit"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by kind, digest, doc and unit: all but the first of each digest, and all of kind 1."""
    last = None
    for batch in batches:
        if batch.num_rows:
            kind, high, low, doc, unit = (batch.column(k).to_numpy() for k in range(5))
            again = np.r_[last == (high[0], low[0]), (high[1:] == high[:-1]) & (low[1:] == low[:-1])] | (kind == 1)
            last = high[-1], low[-1]
            yield pa.RecordBatch.from_arrays([pa.array(doc[again]), pa.array(unit[again])], names=["doc", "unit"])


def repeated_units(texts: DataFrame, kind: str, whole: bool = False) -> DataFrame:
    """`doc`, `unit` (rep << 32 | number) of each unit whose digest an earlier unit has; `whole`: lines and passages as well.

    Units known to be repeated need no digest any more: theirs is only where they are dealt to.
    """
    digested = texts.select("id", "rep", "text").mapInArrow(lambda it: _digested(it, kind, whole), UNIT)
    dealt = digested.withColumn("high", F.when(F.col("kind") == 1, F.xxhash64("doc", "unit")).otherwise(F.col("high"))).withColumn("low", F.when(F.col("kind") == 1, F.lit(0)).otherwise(F.col("low")))
    return dealt.repartition("high", "low").sortWithinPartitions("kind", "high", "low", "doc", "unit").mapInArrow(_repeated, "doc long, unit long")


def _runs(text: str, own: list[tuple[int, int]], numbers: list[int], least_words: int) -> list[tuple[int, int]]:
    """What goes of runs of the units `numbers` (sorted) that have `least_words` words at least."""
    spans = []
    run: list[int] = []
    for k in [*numbers, None]:
        if run and k != run[-1] + 1:
            start, end = own[run[0]][0], own[run[-1]][1]
            if len(text[start:end].split()) >= least_words:
                # with the run goes what stands before it, or behind it at the text's start
                spans.append((own[run[0] - 1][1] if run[0] else 0, end if run[0] else own[run[-1] + 1][0] if run[-1] + 1 < len(own) else len(text)))
            run = []
        run.append(k)
    return spans


def _passage_spans(text: str, numbers: list[int]) -> list[tuple[int, int]]:
    """From each passage's first word to the word behind it."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    words = text_words(text)
    first, end = passages(words)
    return [(starts[first[k]], starts[end[k]]) for k in numbers]


def _cut(batches: Iterator[pa.RecordBatch], kind: str, least_words: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_units", "n_repeated", "spans", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
    for batch in batches:
        rows = []
        for doc, data, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = data.as_py().decode()
            own = units(text, kind)
            every = sorted(found or ())
            numbers = [u for u in every if u < LINES]
            spans = _runs(text, own, numbers, least_words)
            if len(every) > len(numbers):
                spans += _runs(text, units(text, "line"), [u & NUMBER for u in every if LINES <= u < PASSAGES], 1)
                spans += _passage_spans(text, [u & NUMBER for u in every if u >= PASSAGES])
                joined: list[tuple[int, int]] = []
                for a, z in sorted(spans):
                    if joined and a <= joined[-1][1]:
                        joined[-1] = joined[-1][0], max(z, joined[-1][1])
                    else:
                        joined.append((a, z))
                spans = joined
            kept, at = [], 0
            for a, z in spans:
                kept.append(text[at:a])
                at = z
            rows.append((doc, len(own), len(numbers), [{"start": a, "end": z} for a, z in spans], "".join([*kept, text[at:]])))
        columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([*columns, *batch.columns[3:]], names=[*names, *batch.schema.names[3:]])


def unit_dedup(docs: DataFrame, kind: str = "line", least_words: int = 1, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_units, n_repeated, spans (start, end in code points of the original), kept (the text left), and the columns `carry`.

    Units (`kind`: line, paragraph, or sentence, which cuts lines as well) are compared in lower case with
    their words a space apart; a unit without words is never repeated. Of equal units the earliest stays, by
    doc_id, then place. Neighbouring repeated units form a run, and a run of at least `least_words` words (one:
    every repeated unit; more suit sentences, which recur by chance) is removed with the blanks before it. Whole texts are
    compared; a null text counts as empty. Null ids come last; rows that repeat an id come in the order of
    hashes of their texts. An empty table gives no rows. Other columns of `docs` are left out, whatever their
    names; a carried one that has a result column's name is an error.

    With `whole`, every line that an earlier line equals goes as well, however short, and so do passages
    wherever they start (see `passages`; by 64 bits); n_units and n_repeated still count the units of `kind`.
    A few words may stay at a passage's borders.

    Repeats within a batch are settled there, so a unit that fills a third of the corpus is shuffled once for
    each batch; the others are settled by one sort on the digest.
    """
    texts = keyed(docs, id_col, text_col, tuple(carried(carry, RESULT)))
    # dealt before they are grouped: single rows take less of a shuffle than lists of one
    again = repeated_units(texts, kind, whole).select(F.col("doc").alias("id"), F.shiftright("unit", 32).cast("int").alias("rep"), F.col("unit").bitwiseAND(F.lit(0xFFFFFFFF)).alias("unit"))
    found = again.repartition("id", "rep").groupBy("id", "rep").agg(F.collect_list("unit").alias("found"))
    # the join deals texts out itself: `rep` is mostly a constant, and a deal by it is not taken for the join's own
    joined = texts.join(found, ["id", "rep"], "left").select("doc_id", "text", "found", *(["_carried"] if carry else []))
    more = "".join(f", _carried {f.dataType.simpleString()}" for f in joined.schema.fields[3:])
    cut = joined.mapInArrow(lambda it: _cut(it, kind, least_words), f"doc_id long, n_units long, n_repeated long, spans array<struct<start:long,end:long>>, kept string{more}")
    return cut.select(*RESULT, *(F.col("_carried").getField(c).alias(c) for c in carry))
