import corpus_pipeline
from quillspark.llm import secrets

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before, seen = docs.columns, docs.count(), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        seen[name] = docs.count()
        if name != "mixing":
            assert docs.columns == columns
        if name == "secrets":
            assert secrets.scan(docs).where("size(base) > 0").count() == 0
    assert before > seen["toxicity"] > seen["ngram_jaccard"] > seen["decontamination"] == seen["secrets"] >= seen["mixing"] > 0
    wanted = sorted((r["doc_id"], r["repeats"], r["block"]) for r in docs.collect())
    assert sorted((r["doc_id"], r["repeats"], r["block"]) for r in corpus_pipeline.run(spark, DATA).collect()) == wanted
