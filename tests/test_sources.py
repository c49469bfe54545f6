import json

import pytest
from pyspark.sql import functions as F

from lamina.functions.text import NULL_TOKENS
from lamina.operators import layers, prune
from lamina.operators.stats import fold_summary
from lamina.sources import bundle, cache, datasets, runs


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, 1.5, 'say "hi", | x', True), (2, None, " padded ", False), (3, -2.0, None, True)]
    return spark.createDataFrame(rows, "id bigint, x double, s string, f boolean")


def test_csv_round_trip(spark, table, tmp_path):
    path = str(tmp_path / "t.csv")
    datasets.save(table, path)
    read, metadata = datasets.load(spark, path)
    assert read.schema == table.schema or read.dtypes == table.dtypes
    assert sorted(read.collect()) == sorted(table.collect())
    assert metadata.first()["sample_count"] == 3 and metadata.first()["feature_count"] == 4


def test_csv_null_texts(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("a,b,c\n1,NA,True\n2,x,False\n,null,\n")
    read, _ = datasets.load(spark, str(tmp_path / "raw.csv"))
    assert dict(read.dtypes) == {"a": "double", "b": "string", "c": "string"}
    assert [r["b"] for r in read.collect()] == [None, "x", None]


def test_parquet_and_guards(spark, table, tmp_path):
    path = str(tmp_path / "t.parquet")
    datasets.save(table, path, target_feature="x", history=["depth_pruner"], tags=["a"])
    read, metadata = datasets.load(spark, path)
    datasets.validate(read, metadata)
    row = metadata.first()
    assert (row["target_feature"], row["processing_history"], row["tags"], row["source_path"]) == ("x", ["depth_pruner"], ["a"], path)
    with pytest.raises(datasets.DatasetError):
        datasets.save(table, path)
    datasets.save(table.limit(2), path, overwrite=True)
    assert datasets.load(spark, path)[1].first()["sample_count"] == 2
    with pytest.raises(datasets.DatasetError):
        datasets.validate(table, datasets.load(spark, path)[1])
    table.write.parquet(str(tmp_path / "bare.parquet"))
    for bad in ("bare.parquet", "missing.csv", "t.xlsx"):
        with pytest.raises(datasets.DatasetError):
            datasets.load(spark, str(tmp_path / bad))
    with pytest.raises(datasets.DatasetError):
        datasets.save(table, str(tmp_path / "t.json"))


def test_fingerprint(spark, table):
    def of(df):
        return datasets.dataset_fingerprint(df).first()["data_hash"]

    assert of(table) == of(table.orderBy(F.desc("id")).repartition(3))
    assert len({of(table), of(table.limit(2)), of(table.union(table)), of(table.withColumn("x", F.col("x") + 1)), of(table.select("id"))}) == 5


def test_bundle(spark, tmp_path):
    (tmp_path / "database.csv").write_text("Stack,Eff,Flag\nA | B,10.5,TRUE\nUnknown,nan; nan,FALSE\n")
    (tmp_path / "catalog.csv").write_text("section,Field,Pattern\nStack,Stack,[A | B]\nJV,Eff,\n")
    (tmp_path / "section_keys.json").write_text(json.dumps({"Stack": ["Stack"], "JV": ["Eff", "Flag"]}, indent=4))
    (tmp_path / "nan_equivalents.json").write_text(json.dumps({t: None for t in NULL_TOKENS}))
    loaded = bundle.load_bundle(spark, str(tmp_path))
    assert set(loaded.null_tokens) == set(NULL_TOKENS)
    assert loaded.table.collect() == [("A | B", "10.5", True), (None, None, False)]
    assert bundle.catalog_rows(loaded.catalog) == [("Stack", "Stack", "[A | B]"), ("JV", "Eff", None)]
    assert sorted(prune.section_fields(loaded.section_map, ["JV"]).collect()) == [("JV", "Eff"), ("JV", "Flag")]
    with pytest.raises(datasets.DatasetError):
        bundle.load_bundle(spark, str(tmp_path / "absent"))


def test_cache(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a | b", 1.0), ("c", None), (None, 3.0)], "F string, y double")
    reference = [("s", "F", "[a | b]"), ("t", "y", None)]
    calls = []

    def source():
        calls.append(1)
        return df

    args = (source, reference, "y", str(tmp_path), spark)
    first, catalog = cache.cache_or_compute(*args)
    again, same = cache.cache_or_compute(*args)
    assert len(calls) == 1 and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    assert again.columns == ["F_Layer_0", "F_Layer_1", "y"] and again.count() == 2
    assert layers.surviving_columns(prune.prune_depth(same, 0.5)) == ["F_Layer_0", "y"]
    cache.check_cache(str(tmp_path), "y", spark)
    (version,) = (tmp_path / "target=y").glob("version-*")
    records = spark.read.json(str(version / "features" / "records.json"))
    assert sorted(r["parent"] for r in records.collect()) == ["F", "y"]
    cache.cache_or_compute(*args, force_recompute=True)
    assert len(calls) == 2
    with pytest.raises(datasets.DatasetError):
        cache.cache_or_compute(source, reference, "", str(tmp_path), spark)
    # data without their metadata count as a miss
    for number, version in enumerate((tmp_path / "target=y").glob("version-*")):
        (version / "dataset.parquet.metadata").rename(tmp_path / f"elsewhere{number}")
    cache.cache_or_compute(*args)
    assert len(calls) == 3
    # a run that dies before its last write leaves the earlier version in place
    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(cache, "save_catalog", dies)
    with pytest.raises(RuntimeError):
        cache.cache_or_compute(*args, force_recompute=True)
    monkeypatch.undo()
    table, kept = cache.cache_or_compute(*args)
    assert len(calls) == 4 and table.columns == again.columns and layers.surviving_columns(kept)


def test_runs_and_metrics(spark, tmp_path):
    table = spark.createDataFrame([(1, ["a", "b"], ["g"]), (2, ["a"], ["g"]), (3, None, ["g"])], "id int, tags array<string>, groups array<string>")
    assert runs.filter_runs(table, ["id"], {"tags": "b", "groups": "g"}).collect() == [(1,)]
    scores = spark.createDataFrame([(0, "r", 0.5, 0.25), (1, "r", 1.0, 0.75)], "fold int, metric string, train double, test double")
    runs.append_summary(fold_summary(scores), "run-1", str(tmp_path / "m"))
    runs.append_summary(fold_summary(scores), "run-2", str(tmp_path / "m"))
    stored = {(r["run_id"], r["split"]): r["value"] for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert len(stored) == 8 and stored["run-2", "mean_test"] == 0.5 and stored["run-1", "std_train"] == 0.25
