"""Readers and writers on files in a scratch folder."""

import tempfile

from cohortspark.sources import tables as S


def scratch():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_nan_becomes_null_and_columns_are_mapped(spark):
    p = scratch() + "/a"
    spark.createDataFrame([("a", float("nan")), ("b", 2.0)], "sample string, score double").write.parquet(p)
    df = S.read_table(spark, p, "animals", {"animal_id": "sample"}, ["animal_id", "score"])
    assert {r.animal_id: r.score for r in df.collect()} == {"a": None, "b": 2.0}


def test_semicolon_csv_round_trip(spark):
    p = scratch() + "/m"
    rows = spark.createDataFrame([("s1", "a1", 10.0), ("s2", "a2", None)], "sample_id string, sample_name string, day double")
    S.write_csv(rows, p, ";")
    got = S.read_csv(spark, p, "sample_id string, sample_name string, day double", ";")
    assert sorted(got.collect()) == sorted(rows.collect())


def test_day_sheet(spark):
    p = scratch() + "/w"
    spark.createDataFrame([("S-1", "0", None, "1.5")], "sample_id string, d0 string, d1 string, d2 string").write.option("header", True).csv(p)
    got = sorted((r.sample_id, r.day, r.score) for r in S.read_day_sheet(spark, p, ["sample_id"], "score").collect())
    assert got == [("S_1", 0, 0.0), ("S_1", 2, 1.5)]


def test_cache_and_resume(spark):
    p = scratch()
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)
    assert S.load_or_build(spark, p + "/t", build).count() == 5
    assert S.load_or_build(spark, p + "/t", build).count() == 5 and len(calls) == 1
    tasks = spark.range(4).withColumnRenamed("id", "task_id")
    assert S.pending(tasks, p + "/log", "task_id").count() == 4
    S.append_results(tasks.where("task_id < 3"), p + "/log")
    assert [r.task_id for r in S.pending(tasks, p + "/log", "task_id").collect()] == [3]


def test_partitioned_write(spark):
    p = scratch() + "/p"
    d = spark.createDataFrame([("s", i) for i in range(20)] + [("t", 1)], "section_id string, v int")
    S.write_partitioned(d, p, files_per_key=4)
    assert spark.read.parquet(p).where("section_id = 's'").count() == 20
