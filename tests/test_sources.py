"""Scans, sinks and the streaming extension."""

import json

import pytest
from pyspark.sql import functions as F

from longpanel.sources import tables
from longpanel.streaming.incremental import incremental_history


def test_delimited_missing_values(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("id\ty\n1\t2.5\n2\t\n3\tNA\n4\tNaN\n")
    rows = tables.read_delimited(spark, str(tmp_path / "x.tsv"), "id string, y double", "\t").collect()
    assert [(r["id"], r["y"]) for r in rows] == [("1", 2.5), ("2", None), ("3", None), ("4", None)]


def test_ragged_rows(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿id,when,a,b\nu1,1/2/2024 9:30,1,2,and, more\nu2,13/2/2024 10:00,x,4\n", encoding="utf-8")
    df = tables.read_ragged(spark, str(tmp_path / "r.csv"), {"id": "string", "when": "string", "a": "int"})
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("u1", "1/2/2024 9:30", 1), ("u2", "13/2/2024 10:00", None)]
    days = df.orderBy("id").select(F.date_format(tables.day_first_timestamp(F.col("when")), "yyyy-MM-dd").alias("d")).collect()
    assert [r["d"] for r in days] == ["2024-02-01", "2024-02-13"]


def test_ragged_row_too_short_raises(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,a,b\nu1,1\n")
    with pytest.raises(Exception, match="too short"):
        tables.read_ragged(spark, str(tmp_path / "s.csv"), {"id": "string", "b": "int"}).collect()
    with pytest.raises(ValueError, match="missing"):
        tables.read_ragged(spark, str(tmp_path / "s.csv"), {"zz": "int"})


def test_sinks_and_hashes(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "x")
    made = tables.write_all({"a.parquet": df, "b.csv": df}, str(tmp_path / "out"), seed=1, checks={"rows": 3})
    assert set(made["outputs"]) == {"a.parquet", "b.csv"}
    assert spark.read.parquet(str(tmp_path / "out/a.parquet")).count() == 3
    text = spark.read.text(str(tmp_path / "out/manifest.json")).first()["value"]
    assert json.loads(text)["checks"] == {"rows": 3}
    (tmp_path / "f.txt").write_text("abc")
    tables.require_hash(spark, str(tmp_path / "f.txt"), "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD")
    with pytest.raises(ValueError, match="sha256"):
        tables.require_hash(spark, str(tmp_path / "f.txt"), "00")


def test_stream_gives_the_batch_features(spark, tmp_path):
    values = [3.0, 1.0, None, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0]
    for part, span in enumerate((range(0, 5), range(5, 11))):
        spark.createDataFrame([(1, i, values[i]) for i in span], "entity long, ord long, y double").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    # one file a trigger, in order
    source = tmp_path / "src"
    source.mkdir()
    for part in (0, 1):
        made = next((tmp_path / f"in/{part}").glob("part-*.parquet"))
        made.rename(source / f"{part}.parquet")
    stream = spark.readStream.schema("entity long, ord long, y double").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = incremental_history(stream).writeStream.format("memory").queryName("history").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = {r["ord"]: r for r in spark.table("history").collect()}
    query.stop()
    assert rows[3]["streak"] == 1 and rows[4]["streak"] == 0
    seen = [v for v in values[:10] if v is not None]
    assert rows[10]["running_mean"] == pytest.approx(sum(seen) / len(seen))
    m = sum(seen[:8]) / 8
    for y in seen[8:]:
        m = 7 / 9 * m + 2 / 9 * y
    assert rows[10]["ewm"] == pytest.approx(m)


def test_cohort_specifications(spark, tmp_path):
    """A long and a wide source with participants of any type, filters and missing values, as one panel."""
    from longpanel.sources import cohorts, tables

    spark.createDataFrame([("ann", 2, "mood", 3.0), ("ann", 1, "mood", 1.0), ("bob", 1, "mood", None), ("ann", 3, "other", 9.0), ("ann", 4, "mood", 7.0)], "who string, at int, what string, v double").write.parquet(f"{tmp_path}/diary.parquet")
    spark.createDataFrame([(7, 1, 2, 3.5), (7, 2, None, 1.5), (8, 1, 5, None)], "pid int, wave int, a int, b double").write.parquet(f"{tmp_path}/waves.parquet")
    before = dict(cohorts.SPECS)
    try:
        cohorts.register("diary", cohorts.Cohort("diary", "who", ["at"], {"mood": cohorts.Scale(0, 10, -1.0)}, kind="what", value="v", where="at < 4"))
        cohorts.register("waves", cohorts.Cohort("waves", "pid", ["wave"], {"a": cohorts.Scale(0, 5), "total": cohorts.Scale(0, 9)}, values={"a": "a", "total": "a + b"}))
        rows = cohorts.panel(spark, str(tmp_path), ["diary", "waves"]).collect()
        assert sorted((r["dataset"], r["outcome"], r["participant"], r["y"], r["rn"], r["n"], r["direction"]) for r in rows) == [
            ("diary", "mood", "ann", 1.0, 1, 2, -1.0), ("diary", "mood", "ann", 3.0, 2, 2, -1.0),
            ("waves", "a", "7", 2.0, 1, 1, 1.0), ("waves", "a", "8", 5.0, 1, 1, 1.0), ("waves", "total", "7", 5.5, 1, 1, 1.0),
        ]
        assert len({r["cell"] for r in rows}) == 3 and {r["id"] for r in rows if r["dataset"] == "waves"} == {7, 8}
        assert tables.cohort(spark, str(tmp_path), "diary").count() == 3
        plan = cohorts.reports(spark, str(tmp_path), "waves").select("outcome", "y")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "wave" not in plan.split("ReadSchema")[1]
    finally:
        cohorts.SPECS.clear()
        cohorts.SPECS.update(before)
    scale = cohorts.Scale(0, 1)
    for bad in (cohorts.Cohort("t", "p", ["o"], {"x": scale}), cohorts.Cohort("t", "p", ["o"], {"x": scale}, values={"y": "y"}), cohorts.Cohort("t", "p", ["o"], {"x": cohorts.Scale(1, 1)}, values={"x": "x"})):
        with pytest.raises(ValueError):
            cohorts.register("bad", bad)
    with pytest.raises(KeyError, match="no cohort"):
        cohorts.reports(spark, "", "none")
