"""SentencePiece models encoded and decoded by the tokenizers library."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import carried
from quire.llm.tokens import _ranges

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Distinct words a Python worker keeps between batches, and bytes of text put together at once.
MOST_WORDS, CHUNK = 250_000, 4 << 20
#: Words given to the libraries at once: what they return for each is much larger than its ids.
AT_ONCE = 10_000
#: Words put together into one text for the libraries.
TOGETHER = 32


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What a model file says: pieces with scores and kinds, and how texts are normalised."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    unknown_surface: str = " ⁇ "

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                model.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                model.kind = own.get(3, UNIGRAM)
                if own.get(24):
                    raise ValueError("models that treat blanks as suffixes are not supported")
                model.unknown_surface = own[44].decode() if 44 in own else model.unknown_surface
            elif number in (3, 5):
                own = dict(_fields(value))
                if number == 5 and own.get(2):
                    raise ValueError("models with a denormaliser are not supported")
                if number == 5:
                    continue
                model.charsmap = own.get(2, b"")
                model.dummy_prefix, model.squeeze, model.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        return model


def built(model: PieceModel):
    """A tokenizer with the model's normaliser, word mark, scores (as merges for a BPE model) and byte fallback."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    names = [p for p, _, _ in model.pieces]
    kinds = [k for _, _, k in model.pieces]
    unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else None
    fallback = BYTE in kinds
    if model.kind == UNIGRAM:
        # pieces that never match text stand below every path
        core = models.Unigram([(p, s if k in (NORMAL, USER, BYTE) else -1e9) for p, s, k in model.pieces], unknown, fallback)
    elif model.kind == BPE:
        vocabulary = {p: k for k, p in enumerate(names)}
        usable = {p for p, _, k in model.pieces if k in (NORMAL, USER)}
        parts = [(-score, vocabulary[p[:cut]], vocabulary[p[cut:]], p[:cut], p[cut:]) for p, score, k in model.pieces if k in (NORMAL, USER) for cut in range(1, len(p)) if p[:cut] in usable and p[cut:] in usable]
        core = models.BPE(vocabulary, [x[3:] for x in sorted(parts)], unk_token=names[unknown] if unknown is not None else None, fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    tokenizer.add_tokens([AddedToken(p, normalized=True) for p, _, k in model.pieces if k == USER])
    return tokenizer


class PieceTable:
    """Texts of ids, from the model file alone."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.data = file.read()
        m = self.model = PieceModel.parse(self.data)
        shown = []
        for p, _, k in m.pieces:
            shown.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else m.unknown_surface.encode() if k == UNKNOWN else p.replace(MARK, " ").encode())
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.sizes = np.array([len(x) for x in shown], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks as spaces, byte pieces joined, control pieces left out, the added prefix dropped."""
        ids = np.asarray(ids, np.int64)
        data = self.shown[_ranges(self.begins[ids], self.sizes[ids])].tobytes()
        text = data.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


class PieceCodec(PieceTable):
    """Ids of texts and texts of ids; each distinct word is encoded once where the model allows it.

    If no piece has a word mark behind another character, no merge or path crosses from a word to the mark of
    the next, so a text's ids are its words' ids in turn.
    """

    def __init__(self, path: str, threads: int = 2, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        super().__init__(path)
        self.tokenizer = built(self.model)
        m = self.model
        self.by_word = m.dummy_prefix and m.escape and not m.charsmap and not any(k == USER or (k == NORMAL and MARK in p.lstrip(MARK)) for p, _, k in m.pieces)
        self.reference = None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        self.marked = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        self.plain = np.array([k not in (CONTROL, UNKNOWN) for _, _, k in m.pieces])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.agreed = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _both(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.reference is None:
            return ids, [True] * len(texts)
        return ids, [a == b for a, b in zip(ids, self.reference.encode(texts, num_threads=1), strict=True)]

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words end to end, how many each has, and whether the libraries agree; none may have a blank or a mark."""
        lists, agreed = self._both([" ".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)])
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))
        starts = np.flatnonzero(self.marked[ids])  # each word begins with the only mark it has
        if len(starts) == len(words) and all(agreed):
            return ids, np.diff(np.r_[starts, len(ids)]), np.ones(len(words), bool)
        lists, agreed = self._both(words)
        return np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists))), np.fromiter(map(len, lists), np.int64, len(lists)), np.array(agreed, bool)

    def texts(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of lists of ids by the tokenizer's decoder; control pieces are left out, and a list with an unknown piece goes by the table."""
        known = [self.plain[x].all() for x in ids]
        found = iter(self.tokenizer.decode_batch([x.tolist() for x, k in zip(ids, known, strict=True) if k]))
        return [next(found) if k else self.decode(x) for x, k in zip(ids, known, strict=True)]

    def _places(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MOST_WORDS:
            self._forget()
        unknown = [w for w in words if w not in self.known]
        for at in range(0, len(unknown), AT_ONCE):
            new = unknown[at : at + AT_ONCE]
            ids, sizes, agreed = self._of_words(new)
            self.known.update(zip(new, range(len(self.agreed), len(self.agreed) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, ids])
            self.agreed = np.concatenate([self.agreed, agreed])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text (none for a null one), and whether the reference library gives the same."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, f"^ | \\z|  |{MARK}"), pc.equal(texts, "")).to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        out: list[np.ndarray] = [None] * len(texts)
        same = np.ones(len(texts), bool)
        whole = np.flatnonzero(odd)
        for at in range(0, len(whole), 256):
            rows = whole[at : at + 256].tolist()
            for k, ids, agreed in zip(rows, *self._both([texts[k].as_py() for k in rows]), strict=True):
                out[k], same[k] = np.array(ids, np.uint32), agreed
        rows = np.flatnonzero(~odd)
        sizes = pc.binary_length(texts).to_numpy()[rows]
        for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1):
            if len(part):
                units = pc.split_pattern(texts.take(pa.array(part)), " ")
                counts = pc.list_value_length(units).to_numpy()
                coded = pc.list_flatten(units).dictionary_encode()
                which = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                starts, lengths = self.starts[which], self.starts[which + 1] - self.starts[which]
                lead = np.cumsum(counts) - counts
                same[part] = np.logical_and.reduceat(self.agreed[which], lead)
                ids = self.flat[_ranges(starts, lengths)]
                for k, own in zip(part.tolist(), np.split(ids, np.cumsum(np.add.reduceat(lengths, lead))[:-1]), strict=True):
                    out[k] = own
        return out, same


_codecs: dict[tuple, PieceCodec] = {}


def codec(path: str, threads: int, verify: bool) -> PieceCodec:
    """One for each Python worker, model and setting."""
    if (path, threads, verify) not in _codecs:
        _codecs[path, threads, verify] = PieceCodec(path, threads, verify)
    return _codecs[path, threads, verify]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, threads: int, verify: bool, decode: bool) -> Iterator[pa.RecordBatch]:
    pieces = codec(path, threads, verify)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            ids, same = pieces.encode(part.column(part.num_columns - 1).cast(pa.string()))
            agreed = pa.array(same) if verify else pa.nulls(len(ids), pa.bool_())
            columns = [*part.columns[:-1], pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), agreed]
            again = [pa.array([t for k in range(0, len(ids), 250) for t in pieces.texts(ids[k : k + 250])], pa.string())] if decode else []
            yield pa.RecordBatch.from_arrays([*columns, *again], names=[*part.schema.names[:-1], "ids", "n_ids", "parity", *["decoded"] * decode])


def encode_pieces(docs: DataFrame, path: str, threads: int = 2, verify: bool = True, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), decode: bool = False) -> DataFrame:
    """One row per input row: doc_id, `carry`, ids (little-endian unsigned 32-bit), n_ids, parity, and with `decode` the text of the ids as `decoded`.

    Ids are those of the SentencePiece model at `path`, by the tokenizers library; distinct words, or whole
    texts where words can't be told apart, go to it in batches on `threads` threads. `parity` says whether
    the sentencepiece library gives the same ids for all of them (null unless `verify`). A null or empty
    text has no ids and decodes to an empty one. Rows that repeat an id are encoded once each. An empty table
    gives no rows. Other columns of `docs` are left out, whatever their names; a carried one that has a
    result column's name is an error.
    """
    own = ("doc_id", "ids", "n_ids", "parity", "_text", *["decoded"] * decode)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carried(carry, own), F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _encoded(it, path, threads, verify, decode), f"{schema}, ids binary, n_ids long, parity boolean" + ", decoded string" * decode)


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces = codec(path, 2, False)
    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            given = part.column(part.num_columns - 1)
            found = iter(pieces.texts([np.frombuffer(x.as_buffer(), "<u4") for x in given if x.is_valid]))
            texts = [next(found) if x.is_valid else None for x in given]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])


def decode_pieces(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of the ids (null for null): bytes that are no UTF-8 become U+FFFD."""
    columns = [c for c in encoded.columns if c != ids_col]
    rows = encoded.select(*columns, ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lambda it: _decoded(it, path), f"{schema}, decoded string")
