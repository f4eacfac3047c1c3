"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import carried, text_or_empty

FEATURES = (
    "log_bytes", "log_words", "upper", "lower", "digit", "blank", "sentence_marks", "other_marks", "symbols", "control", "beyond_ascii",
    "bytes_per_word", "longest_word", "words_per_line", "distinct_words", "distinct_pairs", "top_word", "repeated_lines", "marked_words", "capital_words", "one_letter_words", "mark_runs",
)

#: Labelled rows a model is fitted on at most (those of the smallest hash); trees, their depth, bins of a feature.
MOST_ROWS, TREES, DEPTH, BINS = 20_000, 80, 4, 64

_CLASS = np.zeros(256, np.uint8)
for _k, _members in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\n\v\f\r", b".,;:?!'\"", b"()-_/", b"#$%&*+<=>@[\\]^`{|}~", [*range(9), *range(14, 32), 127], range(128, 256)), 1):
    _CLASS[list(_members)] = _k


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each whole text; shares are of bytes or of words, 0 for an empty text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        size = len(text)
        row[0] = np.log1p(size)
        if not size:
            continue
        kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10)
        row[2:11] = kinds[1:] / size
        words = text.split()
        count = len(words)
        row[1] = np.log1p(count)
        if not count:
            continue
        often = Counter(words)
        lines = text.split(b"\n")
        row[11] = size / count
        row[12] = max(map(len, often))
        row[13] = count / len(lines)
        row[14] = len(often) / count
        row[15] = len(set(zip(words, words[1:], strict=False))) / max(1, count - 1)
        row[16] = max(often.values()) / count
        row[17] = 1 - len(set(lines)) / len(lines)
        row[18] = sum(n for w, n in often.items() if not w[-1:].isalnum() and w[-1] < 128) / count
        row[19] = sum(n for w, n in often.items() if w.isupper()) / count
        row[20] = sum(n for w, n in often.items() if len(w) == 1) / count
        row[21] = sum(n for w, n in often.items() if len(w) > 1 and _CLASS[w[-1]] in (5, 6, 7) and w[-1] == w[-2]) / count
    return out


@dataclass(frozen=True)
class Forest:
    """Complete binary trees, level by level in flat arrays: row t of `feature` and `threshold` has the inner nodes of tree t, of `value` its leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all rows go down all trees, one level at a time."""
        margin = np.full(len(x), self.start)
        inner = self.feature.shape[1] if len(self.feature) else 0
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - inner]
        return 1 / (1 + np.exp(-margin))


def boosted(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Forest:
    """Gradient boosting of the logistic loss; splits are chosen from histograms of binned features."""
    inner = 2**depth - 1
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = [np.unique(np.quantile(column, np.arange(1, bins) / bins)) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    margin = np.full(len(y), start)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, at = np.zeros(width), np.zeros((width, 2), np.int64)
            for f in range(x.shape[1]):
                slot = (node - first) * bins + binned[:, f]
                g, h, n = (np.cumsum(np.bincount(slot, w, minlength=width * bins).reshape(width, bins), axis=1) for w in (gradient, weight, None))
                parts = g[:, :-1] ** 2 / (h[:, :-1] + ridge) + (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + ridge)
                gain = np.where((n[:, :-1] >= least) & (n[:, -1:] - n[:, :-1] >= least), parts - g[:, -1:] ** 2 / (h[:, -1:] + ridge), 0)
                cut = gain.argmax(axis=1)
                better = gain[np.arange(width), cut] > best + 1e-9
                best[better] = gain[np.arange(width), cut][better]
                at[better] = np.stack([np.full(width, f), cut], axis=1)[better]
            goes = np.zeros(len(y), bool)
            for k in np.flatnonzero(best > 0):
                f, cut = at[k]
                feature[first + k], threshold[first + k] = f, edges[f][cut]
                goes |= (node == first + k) & (binned[:, f] > cut)
            node = 2 * node + 1 + goes
        leaf = node - inner
        value = -rate * np.bincount(leaf, gradient, minlength=inner + 1) / (np.bincount(leaf, weight, minlength=inner + 1) + ridge)
        margin += value[leaf]
        found.append((feature, threshold, value))
    return Forest(*(np.stack(part) for part in zip(*found, strict=True)), start)


def fold(id_col: str, folds: int) -> Column:
    """The remainder of the id's CRC-32 as text; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(statistics(part.column(1).to_pylist())), pa.list_(pa.float64()))], names=["label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """A forest for `label_col`, from at most `most_rows` labelled documents outside the held-out fold.

    The documents of the smallest hashes of their ids are taken, whole; an id with several labels counts by
    the largest, and of rows that repeat an id the one of the least sha256 of its text. Without labels of both kinds the score is the same for every text.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, 5) != 0))
    chosen = marked.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select("_id", "label", text_or_empty(text_col).cast("binary").alias("text"))
    rows = rows.groupBy("_id", "label").agg(F.min(F.struct(F.sha2("text", 256).alias("digest"), "text")).alias("_row")).select("label", "_row.text")
    found = rows.mapInArrow(_measured, "label int, x array<double>").toArrow()  # at most most_rows rows, one for each chosen id
    if not found.num_rows:
        return boosted(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array(found["x"].to_pylist()), found["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums over them should not depend on it
    return boosted(x[order], y[order])


def _scored(batches: Iterator[pa.RecordBatch], forest: Forest, kept_from: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = np.concatenate([forest.scores(statistics(batch.slice(at, 500).column(batch.num_columns - 1).to_pylist())) for at in range(0, batch.num_rows, 500)] or [np.zeros(0)])
        columns = [*batch.columns[:-1], pa.array(scores), pa.array((scores >= kept_from).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score", "predicted"])


def quality(docs: DataFrame, forest: Forest, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, `carry`, held_out, score (0 to 1), predicted (1 from `threshold` up).

    The score follows from the whole text alone; a null text counts as empty and is scored as well. Rows that
    repeat an id are scored once each. An empty table gives no rows. Other columns of `docs` are left out,
    whatever their names; a carried one that has a result column's name is an error.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *carried(carry, ("doc_id", "held_out", "score", "predicted", "_text")), (fold(id_col, 5) == 0).alias("held_out"), text_or_empty(text_col).cast("binary").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _scored(it, forest, threshold), f"{schema}, score double, predicted int")
