import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.pieces import BPE, BYTE, CONTROL, MARK, NORMAL, UNIGRAM, UNKNOWN, PieceCodec, PieceModel, built, decode_pieces, encode_pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return PieceCodec(PATH)


@settings(max_examples=250, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abehtinosr.,\n\t é▁　ж語😀<s>0x")), max_size=40), max_size=5))
def test_whole_texts_agree_with_the_library(pieces, texts):
    want = pieces.reference.encode(texts)
    ids, same = pieces.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in ids] == want and same.all()
    for x, t in zip(want, texts, strict=True):
        assert pieces.decode(np.array(x, np.int64)) == pieces.reference.decode(x) == t.replace(MARK, " ")


def test_model_file(pieces):
    kinds = [k for _, _, k in pieces.model.pieces]
    assert pieces.model.kind == BPE and len(kinds) == 32_000 and kinds.count(BYTE) == 256 and kinds[:3] == [UNKNOWN, CONTROL, CONTROL]
    assert pieces.by_word and pieces.model.dummy_prefix and not pieces.model.squeeze


def test_unigram_model_takes_the_best_path():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "▁ab": -9.0, "ba": -4.0}
    model = PieceModel([("<unk>", 0.0, UNKNOWN), *((p, s, NORMAL) for p, s in scores.items()), *((f"<0x{k:02X}>", -20.0, BYTE) for k in range(256))], UNIGRAM, squeeze=False)
    tokenizer = built(model)
    assert tokenizer.encode("ab", add_special_tokens=False).tokens == ["▁", "ab"]
    assert tokenizer.encode("é", add_special_tokens=False).tokens == ["▁", "<0xC3>", "<0xA9>"]
    assert tokenizer.decode(tokenizer.encode("ab é", add_special_tokens=False).ids) == "ab é"


def test_round_trip_on_odd_rows(spark, odd_rows, pieces):
    frame = spark.createDataFrame([(*r, 1) for r in odd_rows], "doc_id long, text string, decoded int").repartition(3)
    got = decode_pieces(encode_pieces(frame.drop("decoded"), PATH, carry=("text",)), PATH).collect()
    assert len(got) == len(odd_rows) and all(r.parity and r.decoded == (r.text or "") for r in got)
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got} == {i: pieces.reference.encode(t or "") for i, t in odd_rows}
    assert encode_pieces(frame.limit(0), PATH, verify=False, carry=("decoded",)).count() == 0
