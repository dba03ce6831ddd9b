"""Day-wise tables, their sweep, and constraint checks in one pass."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from newsweave.operators import lifecycle as L, retention as R

NOW = datetime(2026, 9, 20, 7)


def stored(spark, path):
    return sorted((r["id"], r["file"]) for r in R.read_by_day(spark, path, "id INT, at TIMESTAMP").select("id", F.col("_metadata.file_name").alias("file")).collect())


def test_a_sweep_drops_days_and_rewrites_the_boundary_only(spark, tmp_path):
    hours = [2 + 11 * i for i in range(40)]
    rows = [(i, NOW - timedelta(hours=h)) for i, h in enumerate(hours)] + [(99, None)]
    path = str(tmp_path / "table")
    R.write_by_day(spark.createDataFrame(rows, "id INT, at TIMESTAMP"), "at", path)
    before = dict(stored(spark, path))
    done = R.sweep(spark, path, "at", NOW, 10)
    after = dict(stored(spark, path))
    limit = NOW - timedelta(days=10)
    assert sorted(after) == sorted(i for i, at in rows if at is None or at >= limit)
    assert done["rewritten"] == [limit.date()] and max(done["dropped"]) < limit.date()
    day = {i: at.date() if at else None for i, at in rows}
    assert all(after[i] == before[i] for i in after if day[i] != limit.date())
    assert all(after[i] != before[i] for i in after if day[i] == limit.date())
    assert set(R.day_folders(spark, path)) == {day[i] for i in after}
    assert R.sweep(spark, path, "at", NOW, 10) == {"dropped": [], "rewritten": []}
    assert dict(stored(spark, path)) == after


def test_a_table_can_be_swept_empty(spark, tmp_path):
    path = str(tmp_path / "table")
    R.write_by_day(spark.createDataFrame([(1, NOW - timedelta(days=30)), (2, NOW - timedelta(days=10, hours=1))], "id INT, at TIMESTAMP"), "at", path)
    before = R.day_files(spark, path, "at").cache()
    assert before.count() == 2
    done = R.sweep(spark, path, "at", NOW, 10)
    assert done == {"dropped": [date(2026, 8, 21)], "rewritten": [date(2026, 9, 10)]}
    report = R.sweep_report(before, R.day_files(spark, path, "at"))
    assert sorted((r["n_before"], r["n_after"], r["same_files"]) for r in report.collect()) == [(1, 0, False), (1, 0, False)]


def test_rules_of_a_table_are_counted_in_one_pass(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (2, None, "x"), (3, "q", "y"), (None, "a", "z"), (None, "a", "z")], "id INT, kind STRING, name STRING")
    report = L.violations(rows, {"kind": L.not_in("kind", ("a", "b")), "never": F.lit(False)}, {"id": ["id"], "pair": ["kind", "name"]})
    assert {r["rule"]: r["n_violations"] for r in report.collect()} == {"kind": 2, "never": 0, "id": 2, "pair": 1}
    empty = L.violations(rows.limit(0), {"kind": L.not_in("kind", ("a",))}, {"id": ["id"]})
    assert {r["rule"]: r["n_violations"] for r in empty.collect()} == {"kind": 0, "id": 0}
