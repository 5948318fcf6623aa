"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfghjklmn" for b in "aeiou"]
    text = lambda n: " ".join("".join(rng.choice(words) for _ in range(3)) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        t = text(40)
        if i % 10 == 0:
            t = t.replace(" ", " moron ", 2)
        rows.append((i, t))
        labels.append((i, 1, int(i % 10 == 0)))
    item = text(20)
    rows += [(1000, rows[1][1]), (1001, rows[1][1].replace(rows[1][1].split()[0], "changed", 1)), (1002, text(5) + " " + item + " " + text(5)), (1003, "token = abcdefghij1234 " + text(30)), (1004, None), (1005, ""), (None, text(30))]
    out = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([("a", item), ("b", None)], "item_id string, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
        before, docs = docs, spark.read.parquet(f"{folder}/out{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if k < 4:
            assert sorted(docs.columns) == sorted(before.columns)
    assert kept["toxicity"] == {i for i in range(300) if i % 10} | {1000, 1001, 1002, 1003, 1004, 1005, None}
    assert kept["toxicity"] - kept["near_duplicates"] == {1000, 1001}
    assert kept["near_duplicates"] - kept["decontamination"] == {1002}
    masked = spark.read.parquet(f"{folder}/out3").where("doc_id = 1003").first()
    assert masked.text.startswith("[SECRET] ") and masked.n_chars == len(masked.text)
    assert kept["packing"] == kept["secrets"] == kept["decontamination"]
    packed = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("o"))
    assert packed.where("n > 4096 or o != 0").count() == 0


def test_run_equals_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() == 300 - 30 + 4


def test_rows_that_repeat_and_no_labels(spark, folder, tmp_path):
    """Without labels nothing goes as toxic; of rows with one text one stays, also without ids; empty tables pass through."""
    rng = random.Random(12)
    text = lambda: " ".join(f"q{rng.randrange(10_000)}" for _ in range(30))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, a), (None, a), (2, b), (2, c), (None, b), (None, c), (None, c), (5, ""), (None, None), (6, text())]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).repartition(3)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == len(rows)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    want = [(1, a), (2, b), (2, c), (5, ""), (None, None), rows[-1]]
    assert sorted(kept, key=str) == sorted(want, key=str)
    assert corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == len(rows)
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
