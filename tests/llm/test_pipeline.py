"""The pipeline's stages keep the columns, and each one's decisions take effect."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 3000)}"
    line = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for k in range(60):
        rows.append((k, "\n".join(line(30) for _ in range(3)), "en", "s", 0))
    rows.append((100, rows[0][1], "en", "s", 0))  # an exact copy: all its lines go
    rows.append((101, line(100) + "\n" + line(30) + " mail a@b.co", "en", "s", 0))
    rows.append((102, None, None, None, None))
    rows.append((103, "too short", "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns, name
            texts = {r.doc_id: r.text for r in kept.collect()}
        if k == 0:
            first = set(texts)
            assert {100, 101} < first <= {*range(60), 100, 101} and len(first) >= 58
        elif k == 1:
            assert texts[100] == "" and texts[0] == rows[0][1]
        elif k == 3:
            assert texts[101].endswith("mail [EMAIL]")
    assert {r.doc_id for r in kept.collect()} == first
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept.count()
