"""Token ids of whole texts from each distinct word's ids, for byte-level vocabularies."""

from __future__ import annotations

import gc
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A text is regular if each blank in it is one space or one line feed between two other characters.
IRREGULAR = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^[ \n]|[ \n]\z|[ \n][ \n]"
#: Distinct words whose ids a Python worker keeps between batches.
MOST_WORDS = 600_000
#: Bytes of text that are put together at once.
CHUNK = 8 << 20
#: A word of Latin letters, marks behind it: the pattern parts it there and nowhere else.
PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


class WordIds:
    """Ids of texts by a byte-level tokenizer, each distinct word encoded once.

    The vocabulary's pattern never joins characters across a blank, and takes a single space with the word
    after it and a line feed alone, so in a regular text the words' ids in turn are the text's ids. Words
    are encoded many at a time, a line feed between them. Irregular texts and those that hold an added token
    are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self._encode("\n")
        self.by_word = len(self.feed) == 1 and self.tokenizer.normalizer is None and self._encode("a b\nc").tolist() == [*self._encode("a"), *self._encode(" b"), *self.feed, *self._encode("c")]
        # a byte's stand-in in the vocabulary: itself where it prints, else the next free letter from 256 up
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, new: list[str]) -> None:
        """`new`: words, with a leading space or without; none holds a blank elsewhere."""
        found: list[list[int]] = []
        rest: list[int] = []
        parts, tokenize, letters, plain = self.parts, self.tokenizer.model.tokenize, self.letters, PLAIN.fullmatch

        def learnt(part: str) -> list[int]:
            shown = part.replace(" ", letters[32]) if part.isascii() else part.encode().decode("latin-1").translate(letters)
            ids = parts[part] = [t.id for t in tokenize(shown)]
            return ids

        for k, word in enumerate(new):
            if match := plain(word):
                word, marks = match.groups()
                if (ids := parts.get(word)) is None:
                    ids = learnt(word)
                found.append(ids + (parts.get(marks) or learnt(marks)) if marks else ids)
            else:
                found.append([])
                rest.append(k)
        for at in range(0, len(rest), 500):
            few = rest[at : at + 500]
            ids = self._encode("\n".join(new[k] for k in few))
            for k, own in zip(few, np.split(ids, np.flatnonzero(ids == self.feed[0])), strict=True):
                found[k] = [i for i in own.tolist() if i != self.feed[0]]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        more = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        first = len(self.starts) - 1
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.flat, self.starts = np.concatenate([self.flat, more]), np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes)])

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the ids of each of `words`, which are distinct, begin in `starts`."""
        if len(self.known) > MOST_WORDS:
            self._forget()
        places = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(places < 0)):
            places[new] = len(self.starts) - 1 + np.arange(len(new))
            self._learn([words[k] for k in new.tolist()])
        return places

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids (uint32) of each text; a null text has none."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, IRREGULAR), pc.equal(texts, ""))
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        out: list[np.ndarray] = [None] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = self._encode(texts[k].as_py())
        rows = np.flatnonzero(~odd)
        sizes = pc.binary_length(texts).to_numpy()[rows]
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
        gc.disable()  # the many small lists made here are kept, and hold no cycles
        try:
            for part in np.split(rows, cuts):
                if len(part):
                    for k, ids in zip(part.tolist(), self._regular(texts.take(pa.array(part))), strict=True):
                        out[k] = ids
        finally:
            gc.enable()
        return out

    def _regular(self, texts: pa.Array) -> list[np.ndarray]:
        # a mark at each text's start and a line's start, so that such words stand without their space
        units = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n"), " ")
        counts = pc.list_value_length(units).to_numpy() - 1
        coded = pc.list_flatten(pc.list_slice(units, 1)).dictionary_encode()
        first = pc.starts_with(coded.dictionary, "\n")
        words = pc.if_else(first, pc.utf8_slice_codeunits(coded.dictionary, 1), pc.binary_join_element_wise(" ", coded.dictionary, ""))
        fed = first.to_numpy(zero_copy_only=False)
        place = self._places(words.to_numpy(zero_copy_only=False).tolist())
        # each distinct unit's ids in one array: a line's first word has the line feed before it
        size = self.starts[place + 1] - self.starts[place] + fed
        begin = np.cumsum(size) - size
        pool = np.full(int(size.sum()), self.feed[0], np.uint32)
        pool[_ranges(begin + fed, size - fed)] = self.flat[_ranges(self.starts[place], size - fed)]
        which = coded.indices.to_numpy()
        sizes, starts = size[which], begin[which].copy()
        lead = np.cumsum(counts) - counts  # a text's first word has none
        starts[lead] += 1
        sizes[lead] -= 1
        ids = pool[_ranges(starts, sizes)]
        ends = np.cumsum(np.add.reduceat(sizes, lead))
        return np.split(ids, ends[:-1])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 ... for sizes[0] numbers, then the same for the next."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
