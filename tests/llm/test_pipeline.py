import corpus_pipeline
from tests.llm.test_dedup_and_join import brute_components, words
from querylens.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), "stage")
        kept[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    before, after = kept["quality classifier"]
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert 0 < after.count() < before.count()
    assert len(bad & {r["doc_id"] for r in after.collect()}) <= 0.2 * len(bad & {r["doc_id"] for r in before.collect()})
    before, after = kept["exact dedup"]
    best = {}
    for r in before.collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == set(best.values())
    before, after = kept["n-gram Jaccard join"]
    want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {c for _, c in want.values()}
    before, after = kept["mixing sources to target weights"]
    assert abs(sum(len(words(r["text"])) for r in after.collect()) / sum(len(words(r["text"])) for r in before.collect()) - 1) < 0.2
    assert kept["BPE encoding and decoding"][1].count() == after.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
