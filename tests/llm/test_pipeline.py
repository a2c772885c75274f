import corpus_pipeline as c

from .helpers import documents, hostile_texts


def test_stages_take_effect(spark, tmp_path):
    texts = [*hostile_texts(), "key token = \"" + "0a1b2c3d" * 5 + "\" " + " ".join(f"word{i}" for i in range(40)), " ".join(f"bench{i}" for i in range(30))]
    docs = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns, name
        now = spark.createDataFrame(out.collect(), docs.schema)
        seen.append(now.count())
    assert seen[0] > seen[1] > seen[2] == seen[3]
    rows = {r.doc_id: r for r in now.collect()}
    assert len(texts) - 1 not in rows and rows[len(texts) - 2].text.startswith("key [secret]")
    assert all(r.n_chars == len(r.text) for r in rows.values())
    packed = c.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(rows)


def test_names_and_registration():
    import __spark_entry__ as e

    assert [n for n, _ in c.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    assert "pipeline" in e.queries() and sum(q.startswith("op") for q in e.queries()) == 10
