import random

from quire.llm.common import written

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(count):
        return " ".join(" ".join(rng.choice(vocabulary) for _ in range(9)).capitalize() + "." for _ in range(count // 9))

    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        docs.append((i, prose(120).upper().replace(" ", "### ") if bad else prose(120), "en", "s"))
        labels.append((i, int(not bad), 0))
    clean = {i for i, *_ in docs if i % 5}
    shared = prose(60)
    docs += [(400, docs[1][1].replace(" ", "  "), "en", "s"), (401, docs[2][1] + " end", "en", "s")]
    docs += [(410 + i, f"{prose(60)} {shared}\n{prose(40)}", "en", "s") for i in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    frame.selectExpr("*", "cast(length(text) as long) n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, str(tmp_path)), name)
        assert now.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    assert clean <= set(kept["quality"]) and not any(i % 5 == 0 and i < 300 for i in kept["quality"])
    assert 400 in kept["quality"] and len({1, 400} & set(kept["exact"])) == 1
    assert 401 in kept["exact"] and 401 not in kept["near"] and clean - {1} <= set(kept["near"])
    assert sum(shared in t for t in kept["near"].values()) == 5 and sum(shared in t for t in kept["substring"].values()) == 1
    assert all(kept["substring"][i] == t for i, t in kept["near"].items() if i < 300)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept["substring"])
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
