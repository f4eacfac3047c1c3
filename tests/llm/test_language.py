import math
import random
import zlib

import numpy as np

from quire.llm.language import codewords, fit_language, language, profiles

SOUNDS = {"aa": "ing the tion and of", "bb": "ung der die schen lich", "cc": "eau les ment çé ou", "dd": "ción los ñe que as", "ee": "ää yö nen ssa kka", "ff": "ow cz sz ski nie"}


def corpus(languages, count, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        lang = languages[i % len(languages)]
        parts = SOUNDS[lang].split()
        rows.append((i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang))
    return rows


def accuracy(spark, languages):
    rows = corpus(languages, 400)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language(frame, fit_language(frame)).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    return sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)


def test_held_out_accuracy(spark):
    assert accuracy(spark, ["aa", "bb", "cc", "dd"]) >= 0.97
    assert accuracy(spark, list(SOUNDS)) >= 0.95  # random codes
    assert accuracy(spark, ["aa", "bb"]) >= 0.97
    assert accuracy(spark, ["aa"]) == 1


def test_odd_rows_and_labels(spark):
    rows = corpus(["aa", "bb", "cc"], 90) + [(900, None, "aa"), (901, "", None), (902, "12 34 !?", "bb"), (None, "ingthe tion", None), (903, "schen lich " * 150_000, None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language(frame, fit_language(frame)).collect()}
    assert len(got) == len(rows)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903].lang_pred == "bb" and got[None].lang_pred == "aa"
    blank = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language(blank, fit_language(blank)).first().lang_pred == "und"
    assert language(frame.limit(0), fit_language(frame)).count() == 0


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 5, 9):
        code = codewords(k)
        gaps = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(gaps) >= (2 ** (k - 2) if k <= 5 else code.shape[1] / 4)


def test_profile_of_a_long_text_is_near_its_parts(monkeypatch):
    text = b"one two three four five six " * 400
    whole = profiles([text, b""])
    monkeypatch.setattr("quire.llm.language.PIECE", 1000)
    assert np.abs(profiles([text])[0] - whole[0]).max() < 0.02 and not whole[1].any()


def test_one_id_on_many_rows_is_one_row_of_the_sample(spark, monkeypatch):
    from quire.llm import language as module

    seen = []
    whole = module.fitted
    monkeypatch.setattr(module, "fitted", lambda x, y, names: seen.append(x.shape) or whole(x, y, names))
    rows = corpus(["aa", "bb"], 60)
    again = next(i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    many = spark.createDataFrame(rows + [(again, f"ing the {k}", "bb" if k % 2 else "aa") for k in range(3000)], "doc_id long, text string, lang string").repartition(3)
    codes = fit_language(many, most_rows=20)
    assert seen[0][0] <= 20 and set(codes.languages) == {"aa", "bb"}


def test_loss_weighted_decoding_matches_plain_sums():
    from quire.llm.language import fitted

    rng = np.random.default_rng(3)
    y = np.arange(90) % 5
    texts = [" ".join(rng.choice(SOUNDS[list(SOUNDS)[k]].split(), 12)).encode() for k in y]
    x = profiles(texts).astype(np.float32)
    codes = fitted(x, y, tuple("abcde"))
    best, score, unsure = codes.decoded(x)
    flat = codes.decoded(np.zeros_like(x))
    for row, found in [(x[k], (best[k], score[k], unsure[k])) for k in range(0, 90, 7)] + [(np.zeros_like(x[0]), tuple(v[0] for v in flat))]:
        distances = []
        for word in codes.words:
            total = 0.0
            for bit in range(len(word)):
                margin = sum(float(a) * float(b) for a, b in zip(row, codes.slope[:, bit])) + float(codes.offset[bit])
                total += float(codes.weight[bit]) * math.log1p(math.exp(-word[bit] * margin))
            distances.append(total)
        order = sorted(range(5), key=distances.__getitem__)
        likely = [math.exp(-d) for d in distances]
        assert found[0] == order[0] and abs(found[1] - likely[order[0]] / sum(likely)) < 1e-4
        assert bool(found[2]) == (likely[order[1]] > 0.5 * likely[order[0]])
    assert (best == y).mean() > 0.9 and flat[2].any()
