import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.packing import Plan, combinations, pack, sequences, solved
from quire.llm.tokens import WordIds

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return WordIds(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'sT.,!? \n\té　 \x1fжß1")), max_size=30), max_size=6))
def test_words_give_the_whole_texts_ids(encoder, texts):
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(pa.array(texts, pa.string()))] == want


def test_forgets_beyond_its_bound(encoder, monkeypatch):
    monkeypatch.setattr("quire.llm.tokens.MOST_WORDS", 3)
    for t in ("one two three four", "five\nsix seven,", "<|endoftext|> x", "one two"):
        assert encoder.encode(pa.array([t]))[0].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 30), max_size=40))
def test_plan_fills_every_window_but_the_last(histogram):
    plan = Plan(histogram, 64, 5)
    used = defaultdict(list)
    for length, n in histogram.items():
        sequence, offset = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            room = min(length, 64 - o)
            used[s].append((o, room))
            if room < length:
                used[s + 1].append((0, length - room))
    assert sorted(used) == list(range(5, plan.sequences))
    for s, parts in used.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 64 or s == plan.sequences - 1


def test_solver_uses_up_what_combinations_can():
    counts = np.zeros(64, np.int64)
    counts[[40, 24, 32, 20, 10, 34]] = [10, 14, 6, 8, 8, 4]
    combos = combinations(counts, 64)
    repeats = solved(combos, counts)
    left = counts - sum(r * np.bincount(c, minlength=64) for r, c in zip(repeats, combos, strict=True))
    assert (repeats >= 0).all() and (left**2).sum() < (counts**2).sum() / 4


def test_pieces_hold_each_id_once(spark, odd_rows, encoder):
    rng = random.Random(3)
    rows = odd_rows + [(700 + i, " ".join(rng.choice(["hey", "jude", "don't", "make"]) for _ in range(40))) for i in range(200)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH, window=256).collect()
    want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in sorted(rows, key=lambda r: r[0])]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length
        by_doc[r.doc_id].append((r.start, ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    repeated = {i for i, _ in odd_rows[-2:]}
    for (i, t), ids in zip(sorted(rows, key=lambda r: r[0]), want, strict=True):
        if i not in repeated:
            assert [x for _, part in sorted(by_doc[i]) for x in part] == ids, i
    assert sum(r.length for r in got) == sum(map(len, want))
    for s, parts in by_sequence.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 256 or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_sequences_are_padded_and_empty_table(spark):
    pieces = pack(spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string"), PATH, window=16)
    row = sequences(pieces, 16, 7).collect()[0]
    ids = np.frombuffer(bytes(row.ids), "<u4")
    assert len(ids) == 16 and row.n_tokens == 5 and (ids[5:] == 7).all() and ids[:5].tolist().count(1) == 2
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_new_words_are_looked_up_once(encoder):
    class Counted(dict):
        asked = 0

        def get(self, *x):
            Counted.asked += 1
            return super().get(*x)

        def __contains__(self, x):
            Counted.asked += 1
            return super().__contains__(x)

        def __getitem__(self, x):
            Counted.asked += 1
            return super().__getitem__(x)

    encoder._forget()
    encoder.known = Counted()
    texts = ["one two three", "three one\ntwo"]
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert Counted.asked == len(encoder.known) == 6
    encoder._forget()
