import corpus_pipeline
from lamina.llm.queries import ORACLES, QUERIES, tokenizer_file
from lamina.llm import decontaminate, mix_sources, simhash, toxicity
from oracle import compare, connect


def test_every_operator_is_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14)) and set(QUERIES) <= set(names) and "pipeline" in names
    assert set(ORACLES) <= set(contract.oracle_sql())


def test_oracles(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in ORACLES.items():
        assert compare(QUERIES[name](spark, sf_dir), sql, con) is None


def test_stages_take_effect(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.materialise(stage(spark, before, sf_dir), "test")
        if number < 4:
            assert after.columns == docs.columns
        ids = [r["doc_id"] for r in after.collect()]
        if number == 0:
            lexicon = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=lambda i: toxicity.remainder(i, 4) != 2)
            gone = {r["id"] for r in toxicity.score(before, lexicon).where("predicted = 1").collect()}
        elif number == 1:
            gone = {r["id"] for r in simhash.near_duplicates(before).where("id <> component_id").collect()}
        elif number == 2:
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            gone = {r["id"] for r in decontaminate.contamination(before, bench).where("contaminated").collect()}
        elif number == 3:
            times = {r["id"]: r["times"] for r in mix_sources.mix(before).collect()}
            assert {i: ids.count(i) for i in times} == times
            gone = {i for i, n in times.items() if not n}
        else:
            gone = set()
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            tokenizer = Tokenizer.from_file(tokenizer_file())
            assert sorted((r["doc_id"], r["n_tokens"]) for r in after.collect()) == sorted(
                (r["doc_id"], len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids) + 1) for r in before.collect()
            )
        assert set(ids) == {r["doc_id"] for r in before.collect()} - gone, name
        before = after


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
