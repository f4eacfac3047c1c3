"""Language identification by error-correcting output codes over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import buckets_for
from quire.llm.quality import fold

#: Buckets of n-grams of one to three bytes; labelled documents a model is fitted on at most, over all languages.
BUCKETS, MOST_ROWS = 4096, 4000
#: Bytes counted at once, and documents counted together.
PIECE, TOGETHER = 1 << 20, 256
UNKNOWN = "und"

_FOLDED = np.arange(256, dtype=np.uint32)
_FOLDED[65:91] += 32
_FOLDED[[k for k in range(128) if not chr(k).isalpha()]] = 32


def profiles(texts: list[bytes]) -> np.ndarray:
    """For each whole text the logarithms of its n-grams' bucket counts, as a vector of length 1 (zero for an empty text)."""
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    flat = counts.reshape(-1)

    def add(rows: list[int], parts: list[bytes]) -> None:
        data = _FOLDED[np.frombuffer(b" ".join(parts), np.uint8)]
        sizes = np.array([len(x) for x in parts], np.int64)
        owner = np.repeat(np.array(rows, np.int64) * BUCKETS, sizes + 1)[: len(data)]
        code = data
        for order in range(3):
            if order:
                code = code[:-1] << np.uint32(8) | data[order:]
            name = (code + np.uint32(order << 28)) * np.uint32(0x9E3779B1)
            flat[:] += np.bincount(owner[: len(code)] + (name >> np.uint32(20)).astype(np.int64), minlength=len(flat))

    held: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if len(text) > PIECE:
            for at in range(0, len(text), PIECE):
                add([k], [text[at : at + PIECE]])
        elif text:
            held.append(k)
            size += len(text)
            if size > PIECE:
                add(held, [texts[j] for j in held])
                held, size = [], 0
    if held:
        add(held, [texts[j] for j in held])
    x = np.log1p(counts.astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and 1 for each language: every split of up to five languages, beyond that the most distant of random codes."""
    if not languages:
        return np.zeros((0, 0))
    if languages <= 5:
        splits = np.array([[1, *(1 if column >> k & 1 else -1 for k in range(languages - 1))] for column in range(2 ** max(0, languages - 1) - 1)])
        return splits.reshape(-1, languages).T.astype(np.float64)
    rng = np.random.default_rng(languages)
    width = int(np.ceil(10 * np.log2(languages)))
    tried = [rng.choice([-1.0, 1.0], size=(languages, width)) for _ in range(100)]
    return max(tried, key=lambda code: -((code @ code.T) - 2 * width * np.eye(languages)).max())


@dataclass(frozen=True)
class Codes:
    """Languages, their codewords, and a linear classifier with a weight for each bit."""

    languages: tuple[str, ...]
    words: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    weight: np.ndarray

    def decoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its score and whether it is ambiguous, for each profile.

        The distance to a codeword is the weighted logistic loss of the bits' margins; the score is the
        share of exp(-distance) that the nearest has. It is ambiguous when no bit decided, or when another
        language has over half of what the nearest has.
        """
        margins = x @ self.slope + self.offset
        distance = np.stack([(self.weight * np.logaddexp(0, -word * margins)).sum(axis=1) for word in self.words], axis=1)
        best = distance.argmin(axis=1)
        share = np.exp(distance.min(axis=1, keepdims=True) - distance)
        score = 1 / share.sum(axis=1)
        second = np.sort(share, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(x))
        return best, score, second > 0.5


def fitted(x: np.ndarray, language: np.ndarray, names: tuple[str, ...], steps: int = 120, ridge: float = 1e-4, rate: float = 40.0) -> Codes:
    """One logistic classifier for each bit, by accelerated gradient descent; languages count alike, whatever their rows."""
    words = codewords(len(names))
    bits = words[language].astype(np.float32)
    share = 1 / np.maximum(np.bincount(language, minlength=len(names)), 1)
    each = (share[language] / max(1, len(names)))[:, None].astype(np.float32)
    slope, offset = np.zeros((x.shape[1], words.shape[1]), np.float32), np.zeros(words.shape[1], np.float32)
    ahead, ahead_offset = slope, offset
    for step in range(steps if words.shape[1] else 0):
        pull = -each * bits / (1 + np.exp(bits * (x @ ahead + ahead_offset)))
        new, new_offset = ahead - rate * (x.T @ pull + ridge * ahead), ahead_offset - rate / 10 * pull.sum(axis=0)
        push = step / (step + 3)
        ahead, ahead_offset = new + push * (new - slope), new_offset + push * (new_offset - offset)
        slope, offset = new, new_offset
    right = (each * (bits * (x @ slope + offset) > 0)).sum(axis=0)
    return Codes(names, words, slope, offset, np.maximum(2 * right - 1, 0.01) * (len(names) > 1))


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            x = profiles(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["id", "lang", "x"])


def smallest(ids: DataFrame, each: int, rows: int) -> DataFrame:
    """Distinct `_id`s: of each `lang` the `each` rows whose ids have the smallest hashes; no language has over `rows`.

    First those of every bucket of a language, then those of its buckets' winners: no task sorts a language.
    """
    order = [F.xxhash64("_id"), F.col("_id")]
    dealt = ids.withColumn("_bucket", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(buckets_for(rows))))
    for groups in (["lang", "_bucket"], ["lang"]):
        dealt = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_at") <= each).drop("_at")
    return dealt.select("_id").distinct()


def fit_language(docs: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Codes:
    """Codes for the values of `lang_col`, from at most `most_rows` labelled documents outside the held-out fold.

    Of each language the same number of documents is taken, those of the smallest hashes of their ids, whole. Of rows
    that repeat an id the one of the least sha256 of its text counts.
    """
    marked = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, 4) != 2))
    counts = marked.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_rows).collect()
    names = tuple(r[0] for r in counts)
    chosen = smallest(marked.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang")), max(1, most_rows // max(1, len(names))), max((r[1] for r in counts), default=0))
    rows = marked.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.groupBy("id").agg(F.min(F.struct(F.sha2("text", 256).alias("digest"), "lang", "text")).alias("_row")).select("id", "_row.lang", "_row.text")
    found = rows.mapInArrow(_profiled, "id long, lang string, x binary").orderBy("id", "lang", "x").toArrow()  # one row for each chosen id
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    at = {name: k for k, name in enumerate(names)}
    return fitted(x, np.array([at[v] for v in found["lang"].to_pylist()], np.int64), names)


def _named(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            text = part.column(2)
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if codes.languages:
                best, score, unsure = codes.decoded(profiles([x or b"" for x in text.cast(pa.binary()).to_pylist()]))
            else:
                best, score, unsure, lettered = np.zeros(part.num_rows, int), np.zeros(part.num_rows), np.ones(part.num_rows, bool), np.zeros(part.num_rows, bool)
            name = [codes.languages[k] if known else UNKNOWN for k, known in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(name, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(np.where(lettered, unsure, True))], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])


def language(docs: DataFrame, codes: Codes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1), ambiguous.

    The prediction follows from the whole text alone. A null text and one without a letter give 'und' with
    score 0, and so does every text when no labelled document was learned from. Rows that repeat an id are
    predicted once each. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, 4) == 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _named(it, codes), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
