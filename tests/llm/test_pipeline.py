"""The pipeline's stages against what each is to keep."""

import corpus_pipeline
from tests.llm import brute


def test_stages_keep_columns_and_take_effect(spark, small, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, small).cache()
        assert docs.columns == documents.columns
        if name == "near_dedup":
            groups = brute.near_components([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, root) in groups.items() if i == root}
        if name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            hit = brute.contamination([(r.doc_id, r.text) for r in before.collect()], bench)
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, n, _) in hit.items() if n == 0}
    assert corpus_pipeline.STAGES[4][1](spark, docs, small).count() == docs.count()


def test_odd_rows_pass(spark, small, odd, none):
    for given in (odd, none):
        docs = given
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, small)
            assert docs.columns == given.columns
        corpus_pipeline.STAGES[4][1](spark, docs, small).count()


def test_rows_that_share_an_id_are_judged_each_for_itself(spark, small):
    """Null ids, and one id on two texts: a copy or a contaminated row takes no other row with it."""
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("item_id = 1").first().text
    words = lambda seed: " ".join(f"{seed}w{i}" for i in range(30))
    rows = [(1, words("a")), (None, words("a")), (None, words("b")), (None, words("b")), (None, words("c")), (2, words("d")), (2, words("e")), (3, words("d")), (None, item), (2, item + " " + words("f")), (4, words("g")), (4, words("g")), (5, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    texts = sorted((str(r.doc_id), r.text[:3] if r.text else r.text) for r in kept.where("text <> ''").collect())
    assert texts == sorted([("1", "aw0"), ("None", "bw0"), ("None", "cw0"), ("2", "dw0"), ("2", "ew0"), ("None", item[:3]), ("2", item[:3]), ("4", "gw0")])
    assert kept.where("coalesce(text, '') = ''").count() == 2
    clean = corpus_pipeline.decontaminate(spark, kept, small)
    assert clean.count() == kept.count() - 2 and clean.where("doc_id IS NULL").count() == 2 and clean.columns == docs.columns
