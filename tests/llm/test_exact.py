from collections import defaultdict

from brute import sha

from lamina.llm.exact import drop_duplicates, duplicate_groups


def test_groups(awkward, rows, nothing):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    expected = []
    for i, t, _ in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        expected.append((i, keep, len(own), i == keep, sha(t)))
    for share in (0.001, 0.04, 0.9):
        got = [tuple(r) for r in duplicate_groups(awkward, hot_share=share).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert duplicate_groups(nothing).count() == 0


def test_one_row_of_each_text_stays(awkward, rows, nothing):
    kept = drop_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len({t or "" for _, t, _ in rows})
    assert drop_duplicates(nothing).count() == 0


def test_no_python_on_the_executors(spark, sf_dir):
    plan = duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
