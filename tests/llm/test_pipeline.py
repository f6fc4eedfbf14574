"""Every stage of the pipeline on a small table."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice(["th", "er", "in", "on", "sh"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    item = text(30)
    rows = [(i, text(80)) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " tail"), (102, text(20) + " " + item), (103, "short"), (104, None), (105, text(60) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + text(10))]
    spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append({r["doc_id"] for r in docs.collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "secret_scan":
            assert "[SECRET]" in docs.where("doc_id = 105").first()["text"]
    clean = set(range(60))
    assert seen[0] == clean | {100, 101, 102, 105}
    assert seen[1] == clean | {102, 105}
    assert seen[2] == seen[3] == seen[4] == clean | {105}


def test_rows_that_repeat_share_an_id_or_have_none(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    one, two, three, item = text(60), text(60), text(60), text(30)
    rows = [(1, one), (1, one), (None, one), (1, two), (5, three), (None, three + " end"), (7, None), (8, item), (8, text(40)), (None, item + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rid string")
    got = corpus_pipeline.near_duplicates(spark, docs.where("text is null or length(text) > 300"), str(tmp_path))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, [(1, one), (1, two), (5, three), (7, None)]))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert len(left) == 8 and not any(item in (r["text"] or "") for r in left)
