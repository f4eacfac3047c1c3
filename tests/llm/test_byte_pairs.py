import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm.byte_pairs import BytePairs, decode_bytes, encode_bytes, merged

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def pairs():
    with open(PATH) as file:
        return BytePairs(file.readlines(), PATTERN)


@pytest.fixture(scope="module")
def library(pairs):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


def plain(word, ranks):
    """Merges by looking at all pairs each time."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[k : k + 1] for k in range(len(word))]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[x] for x in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abehtinosr.,'\n\t é　ж語😀<|>0\x1c")), max_size=80))
def test_any_text_agrees_with_the_library(pairs, library, text):
    ids = pairs._encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert pairs.decode([ids]) == [text.encode()]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=90))
def test_any_bytes_merge_as_all_pairs_say(pairs, word):
    assert merged(word, pairs.ranks) == plain(word, pairs.ranks)
    (ids,) = pairs.merge([word])
    assert memoryview(ids).cast("i").tolist() == plain(word, pairs.ranks)


def test_ties_go_to_the_leftmost_and_small_vocabularies_work():
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"aa", b"aaa"]
    few = BytePairs([f"{base64.b64encode(t).decode()} {k}" for k, t in enumerate(tokens)], r"\w+")
    for word in (b"aaaaa", b"aaaa", b"baab", b"xy"):
        assert merged(word, few.ranks) == plain(word, few.ranks) == memoryview(few.merge([word])[0]).cast("i").tolist()
    assert not few.by_word and few._encode("aa, aaaaa").tolist() == [256, 256, 257]  # what no match covers has no ids
    alone = BytePairs([f"{base64.b64encode(bytes([b])).decode()} {b}" for b in range(256)], PATTERN)
    assert alone._encode("ab c").tolist() == list(b"ab c")
    with pytest.raises(ValueError, match="no token for the bytes"):
        BytePairs(["YQ== 0"], PATTERN)
    with pytest.raises(ValueError, match="lacks"):
        alone.decode([[97, 256]])


def test_whole_rows(spark, odd_rows, library):
    rng = random.Random(2)
    rows = [*odd_rows, (900, "".join(rng.choice("etaoinsh") for _ in range(30_000))), (901, "a" * 70_000), (902, "<|endoftext|>퟿"), (None, "no id"), (903, "don't\nstop 12 now")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_tokens string, decoded int").repartition(3)
    found = encode_bytes(frame.withColumnRenamed("n_tokens", "note"), PATH, PATTERN, carry=("note",), decode=True)
    got = found.collect()
    assert found.columns == ["doc_id", "note", "n_tokens", "ids", "decoded"] and len(got) == len(rows)
    want = sorted((i or -1, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((r.doc_id or -1, r.ids, bytes(r.decoded)) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)
    again = decode_bytes(found.drop("decoded"), PATH, PATTERN).collect()
    assert sorted(((r.doc_id or -1, bytes(r.decoded)) for r in again), key=repr) == sorted(((i, d) for i, _, d in want), key=repr)
    assert encode_bytes(frame.limit(0), PATH, PATTERN).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        encode_bytes(frame, PATH, PATTERN, carry=("n_tokens",))


def test_bytes_that_are_no_utf8(spark):
    frame = spark.sql("select 1L doc_id, cast(x'61ff62' as string) text")
    (row,) = encode_bytes(frame, PATH, PATTERN, decode=True).collect()
    assert bytes(row.decoded).decode() == "a�b"


def test_query(spark, library):
    from quire.llm.queries import QUERIES, table

    docs = "/root/testdata/sf0.001"
    want = {}
    for row in table(spark, docs, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = library.encode_ordinary(row.text)
        want[row.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(row.text.encode()).hexdigest())
    got = QUERIES["op13_byte_pairs"](spark, docs).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
