import random
import zlib

import numpy as np

from quire.llm.quality import FEATURES, boosted, fit_quality, quality, statistics


def corpus(count: int):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(count):
        prose = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 90))) + "."
        good = i % 4 != 0
        docs.append((i, prose if good else rng.choice([prose.upper(), (prose[:12] + " ") * 40, prose.replace(" ", "### ")])))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(600)
    docs += [(1000, None), (1001, ""), (None, "x"), (1002, "word " * 40_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*labels, (5, None), (None, 1), (99_999, 0)], "doc_id long, quality int")
    got = quality(frame, fit_quality(frame, marks)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_scores_do_not_depend_on_the_held_out_labels_or_on_order(spark):
    docs, labels = corpus(200)
    changed = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    found = []
    for order, marks in ((docs, labels), (docs[::-1], changed)):
        frame = spark.createDataFrame(order, "doc_id long, text string").repartition(2 + len(found))
        forest = fit_quality(frame, spark.createDataFrame(marks, "doc_id long, quality int"))
        found.append({r.doc_id: r.score for r in quality(frame, forest).collect()})
    assert found[0] == found[1]


def test_flat_traversal_matches_a_walk_down_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    forest = boosted(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), trees=12, depth=3)
    for row, score in zip(x[:50], forest.scores(x[:50]), strict=True):
        margin = forest.start
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while node < 7:
                node = 2 * node + 1 + (row[feature[node]] > threshold[node])
            margin += value[node - 7]
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-12
    assert ((forest.scores(x) > 0.5) == (x[:, 0] + x[:, 1] ** 2 > 0.5)).mean() > 0.9


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality(docs, fit_quality(docs, none)).collect()} == {0.5}
    assert quality(docs.limit(0), fit_quality(docs, none)).count() == 0
    assert statistics([b"", b" \n", b"One two. two"]).shape == (3, len(FEATURES))


def test_one_id_on_many_rows_is_one_row_of_the_sample(spark, monkeypatch):
    from quire.llm import quality as module

    seen = []
    whole = module.boosted
    monkeypatch.setattr(module, "boosted", lambda x, y: seen.append(x.shape) or whole(x, y))
    docs, labels = corpus(60)
    again = next(i for i, _ in labels if zlib.crc32(str(i).encode()) % 5)
    many = spark.createDataFrame(docs + [(again, f"the {k}") for k in range(3000)], "doc_id long, text string").repartition(3)
    fit_quality(many, spark.createDataFrame(labels + [(again, k % 2) for k in range(50)], "doc_id long, quality int"), most_rows=20)
    assert seen[0][0] <= 20
