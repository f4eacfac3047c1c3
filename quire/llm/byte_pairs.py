"""Byte-level BPE by ranks: a segment tree over byte positions finds each next merge."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import carried
from quire.llm.tokens import WordIds, _ranges

#: Matches a Python worker keeps the ids of, and the longest it keeps.
MOST_WORDS, LONGEST_KEPT = 400_000, 64
#: Patterns that never join characters across a blank and take a single space with what follows it.
BY_WORD = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)
#: Bits of a key of the tree that tell the position; the rank stands above them. The key of no pair.
PLACE, NONE = 40, 1 << 62
#: Bytes of the longest match that is merged together with others, and bytes of those merged at once.
WIDEST, AT_ONCE = 64, 1 << 17
#: Bytes of text whose ids are given back in one batch.
CHUNK = 4 << 20


def merged(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Ids of one match, by merging the pair of the least rank, of equal ones the leftmost, until none has a rank.

    Leaf p of the tree holds rank and position of the pair of the token that starts at byte p and the one
    behind it, or nothing where no token starts or the pair has no rank; an inner node holds the least below
    it, so the root names the next merge. A merge ends one token and changes the pairs of the new token and of
    the live neighbour before it: three leaves, each with its way up. A match of n bytes takes n log n steps.
    """
    size = len(word)
    if size < 2 or word in ranks:
        return [ranks[word]] if word else []
    wide = 1 << (size - 1).bit_length()
    rank = ranks.get
    tree = [NONE] * (2 * wide)
    for p in range(size - 1):
        if (r := rank(word[p : p + 2])) is not None:
            tree[wide + p] = r << PLACE | p
    for node in range(wide - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    def put(p: int, key: int) -> None:
        node = wide + p
        tree[node] = key
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            if other < key:
                key = other
            if tree[node] == key:
                return
            tree[node] = key

    end = list(range(1, size + 1))  # of the token that starts here
    before = list(range(-1, size - 1))  # start of the token before
    while (least := tree[1]) < NONE:
        p = least & ((1 << PLACE) - 1)
        gone = end[p]
        behind = end[p] = end[gone]
        put(gone, NONE)
        if behind < size:
            before[behind] = p
            r = rank(word[p : end[behind]])
            put(p, NONE if r is None else r << PLACE | p)
        else:
            put(p, NONE)
        if (q := before[p]) >= 0:
            r = rank(word[q:behind])
            put(q, NONE if r is None else r << PLACE | q)
    ids, p = [], 0
    while p < size:
        ids.append(ranks[word[p : end[p]]])
        p = end[p]
    return ids


class BytePairs(WordIds):
    """Encoder and decoder of one vocabulary; `lines`: a token in base64 and its rank on each.

    With a pattern of which it is known (BY_WORD) that it parts texts at blanks, `WordIds` gives the distinct
    words of regular texts to `_learn`; other texts, and all with any other pattern, are matched whole.
    """

    def __init__(self, lines: Sequence[str], pattern: str):
        import regex

        pairs = (line.split() for line in lines if line.strip())
        self.ranks = ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary has no token for the bytes {missing[:5]}")
        self.tokens = {rank: token for token, rank in ranks.items()}
        if len(self.tokens) < len(ranks):
            raise ValueError("two tokens of the vocabulary have one rank")
        self.find = regex.compile(pattern).findall
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to part a token into two tokens: which pairs have a rank, and which
        self.many = max(self.tokens) + 1
        parted = [(ranks[t[:k]] * self.many + ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs, self.pair_ranks = (np.array(x, np.int64) for x in zip(*sorted(parted), strict=True)) if parted else (np.zeros(0, np.int64),) * 2
        places = np.full(self.many, -1)
        places[list(self.tokens)] = np.arange(len(self.tokens))
        self.places, self.text = places, np.frombuffer(b"".join(self.tokens.values()), np.uint8)
        self.sizes = np.fromiter(map(len, self.tokens.values()), np.int64, len(self.tokens))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.added: list[str] = []
        self._forget()
        self.feed = self._encode("\n")
        self.by_word = pattern in BY_WORD and len(self.feed) == 1

    def _forget(self) -> None:
        super()._forget()
        self.matches: dict[str, bytes] = {}  # a match's ids, four bytes each

    def _keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Keys of the tree for the pairs of tokens (left, right) at `place`."""
        if not len(self.pairs):
            return np.full(len(left), NONE)
        wanted = left * self.many + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.pair_ranks[at] << PLACE | place, NONE)

    def _merged_alike(self, words: Sequence[bytes], wide: int) -> list[bytes]:
        """The ids that `merged` has for words of 2 to `wide` bytes (a power of two) at once: a tree for each row of an array, all climbed together."""
        count = len(words)
        sizes = np.fromiter(map(len, words), np.int64, count)
        raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(count, wide)
        places = np.arange(wide)
        token = np.where(places < sizes[:, None], self.bytes[raw], -1)
        row, p = np.nonzero(places < sizes[:, None] - 1)
        tree = np.full((count, 2 * wide), NONE)
        tree[row, wide + p] = self._keys(token[row, p], token[row, p + 1], p)
        level = wide
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        end, before = np.tile(places + 1, (count, 1)), np.tile(places - 1, (count, 1))
        flat = tree.reshape(-1)
        row = np.arange(count)
        while len(row := row[tree[row, 1] < NONE]):
            least = tree[row, 1]
            p = least & ((1 << PLACE) - 1)
            gone = end[row, p]
            behind = end[row, p] = end[row, gone]
            token[row, p], token[row, gone] = least >> PLACE, -1
            after, ahead = np.full(len(row), NONE), before[row, p]
            has = np.flatnonzero(behind < sizes[row])
            before[row[has], behind[has]] = p[has]
            after[has] = self._keys(token[row[has], p[has]], token[row[has], behind[has]], p[has])
            led = np.flatnonzero(ahead >= 0)
            # the three leaves that change, then their ways up, level by level
            base = 2 * wide * np.concatenate([row, row, row[led]])
            node = wide + np.concatenate([gone, p, ahead[led]])
            flat[base + node] = np.concatenate([np.full(len(row), NONE), after, self._keys(token[row[led], ahead[led]], token[row[led], p[led]], ahead[led])])
            while node[0] > 1:
                node = node >> 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])
        ids = token[token >= 0].astype(np.int32).tobytes()
        ends = (4 * np.cumsum((token >= 0).sum(axis=1))).tolist()
        return [ids[a:z] for a, z in zip([0, *ends], ends, strict=False)]

    def merge(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of each match, as int32."""
        out: list = [None] * len(words)
        alike: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if (rank := self.ranks.get(word)) is not None:
                out[k] = np.int32(rank).tobytes()
            elif 1 < len(word) <= WIDEST:
                alike.setdefault((len(word) - 1).bit_length(), []).append(k)
            else:
                out[k] = np.array(merged(word, self.ranks), np.int32).tobytes()
        for bits, places in alike.items():
            step = AT_ONCE >> bits
            for at in range(0, len(places), step):
                some = places[at : at + step]
                for k, ids in zip(some, self._merged_alike([words[k] for k in some], 1 << bits), strict=True):
                    out[k] = ids
        return out

    def _joined(self, found: Sequence[Sequence[str]]) -> list[bytes]:
        """The ids of the matches in each list."""
        known = self.matches
        if len(known) > MOST_WORDS:
            known.clear()
        if new := [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in known]:
            known.update(zip(new, self.merge([w.encode() for w in new]), strict=True))
        ids = [b"".join(map(known.__getitem__, matches)) for matches in found]
        for word in new:
            if len(word) > LONGEST_KEPT:
                del known[word]
        return ids

    def _encode(self, text: str) -> np.ndarray:
        """Ids of all matches of the pattern; what no match covers has none, as in the public library."""
        return np.frombuffer(self._joined([self.find(text)])[0], np.uint32)

    def _learn(self, new: list[str]) -> None:
        ids = self._joined([self.find(word) for word in new])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = len(self.starts) - 1
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        more = np.frombuffer(b"".join(ids), np.uint32)
        self.flat, self.starts = np.concatenate([self.flat, more]), np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes)])

    def decode(self, lists: Sequence[np.ndarray]) -> list[bytes]:
        """The tokens' bytes of each list joined; an id that the vocabulary lacks is an error."""
        ids = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
        at = np.where((ids >= 0) & (ids < self.many), self.places[np.clip(ids, 0, self.many - 1)], -1)
        if len(lost := ids[at < 0]):
            raise ValueError(f"ids that the vocabulary lacks: {lost[:5].tolist()}")
        sizes = self.sizes[at]
        joined = self.text[_ranges(self.begins[at], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, lists)])].tolist()
        return [joined[a:z] for a, z in zip(ends, ends[1:], strict=False)]


_loaded: dict[tuple, BytePairs] = {}


def _vocabulary(path: str, pattern: str) -> BytePairs:
    """One for each Python worker, vocabulary and pattern; the file is part of what is installed on every machine."""
    if (path, pattern) not in _loaded:
        with open(path, encoding="ascii") as file:
            _loaded[path, pattern] = BytePairs(file.readlines(), pattern)
    return _loaded[path, pattern]


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's values have some CHUNK bytes each time, a longer value alone."""
    for batch in batches:
        if batch.num_rows:
            sizes = pc.binary_length(batch[column]).fill_null(0).to_numpy().astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                yield batch.slice(a, z - a)


def _readable(texts: pa.Array) -> pa.Array:
    """The bytes as strings; what is no UTF-8 is read as the replacement character."""
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.string())


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int32)))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, carry: list[str], decode: bool) -> Iterator[pa.RecordBatch]:
    pairs = _vocabulary(path, pattern)
    for part in _parts(batches, "_text"):
        ids = pairs.encode(_readable(part["_text"]))
        columns = [*(part[c] for c in carry), pa.array(list(map(len, ids)), pa.int64()), _lists(ids)]
        if decode:
            columns.append(pa.array(pairs.decode(ids), pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names=[*carry, "n_tokens", "ids", *["decoded"] * decode])


def encode_bytes(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), decode: bool = False) -> DataFrame:
    """One row per input row: doc_id, the columns `carry`, n_tokens, ids (array of int), and decoded (the ids' bytes) if asked for.

    Every match of `pattern` in the whole text is encoded by itself with the ranks in the file `path`; no text is
    a special token. A match that is a token is that token; others are merged by `merged`. A null text counts
    as empty and has no ids. Rows that repeat an id are rows of their own, a null id stays null, an empty
    table gives no rows. Other columns may have any name; those of `carry` must not have that of a result column.
    Narrow: nothing is shuffled, and a worker holds the vocabulary and at most MOST_WORDS matches' ids.
    """
    own = ["doc_id", "n_tokens", "ids", *["decoded"] * decode]
    kept = ["doc_id", *carried(carry, own)]
    rows = docs.select(F.col(id_col).alias("doc_id"), *(F.col(c) for c in carry), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept]
    schema = ", ".join([*kinds, "n_tokens long", "ids array<int>", *["decoded binary"] * decode])
    return rows.mapInArrow(lambda it: _encoded(it, path, pattern, kept, decode), schema)


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    pairs = _vocabulary(path, pattern)
    for batch in batches:
        for row in range(0, batch.num_rows, 1000):
            part = batch.slice(row, 1000)
            lists = [np.array(x or [], np.int64) for x in part["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(pairs.decode(lists), pa.binary())], names=["doc_id", "decoded"])


def decode_bytes(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) for rows doc_id, ids; null ids are none. An id that the vocabulary lacks is an error."""
    rows = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda it: _decoded(it, path, pattern), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")
