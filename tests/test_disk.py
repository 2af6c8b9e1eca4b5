"""What a run leaves on disk, and what its plans shuffle."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from bookwright import schema as S
from bookwright.operators import outcomes as O
from bookwright.plans import fixtures as V
from bookwright.plans import queries as Q
from bookwright.session import materialise, shuffles_removed
from bookwright.sinks import tables as W
from bookwright.sources import reports as P

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.length()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def of_parents(spark, n: int = 400):
    return spark.range(n).select(
        F.concat(F.lit("r"), (F.col("id") % 7).cast("string")).alias("report_id"),
        F.lit("Camp").alias("campaign_name"),
        F.col("id").cast("string").alias("job_number"),
    )


def test_a_written_step_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    rows = materialise(of_parents(spark).groupBy("report_id").agg(F.count("*").alias("n")), "counted")
    assert {r.n for r in rows.collect()} <= {57, 58}
    assert not shuffle_files(spark) - before
    assert spark.conf.get(SETTING) == "false"


def test_the_setting_is_put_back(spark):
    spark.conf.set(SETTING, "true")
    try:
        with shuffles_removed(spark):
            pass
        assert spark.conf.get(SETTING) == "true"
    finally:
        spark.conf.unset(SETTING)


def child_rows(spark):
    rows = of_parents(spark).withColumn("child_ord", F.struct(F.lit(0).alias("section"), F.col("job_number").alias("row_ord")))
    return rows.withColumns({c: F.col("job_number") for c in S.CHILD_COLUMNS})


def test_large_tables_are_written_in_slices(spark, tmp_path, monkeypatch):
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    W.write_results({"subtask_results": child_rows(spark)}, whole)
    calls = []
    write = W.write_csv
    monkeypatch.setattr(W, "SLICE_ROWS", 150)
    monkeypatch.setattr(W, "write_csv", lambda *args, **kinds: (calls.append(kinds["slices"]), write(*args, **kinds)))
    before = shuffle_files(spark)
    W.write_results({"subtask_results": child_rows(spark)}, parts)
    W.write_results({"subtask_results": child_rows(spark)}, parts, "overwrite")
    assert calls == [3, 3] and not shuffle_files(spark) - before

    def lines(path: str) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for file in sorted(glob.glob(f"{path}/subtask_results/report_id=*/*.csv")):
            with open(file) as f:
                found.setdefault(os.path.basename(os.path.dirname(file)), []).extend(f.read().splitlines()[1:])
        return found

    assert len(lines(whole)) == 7 and lines(parts) == lines(whole)


def test_bookings_shuffle_no_whole_rows_but_for_the_orders(spark):
    """With nothing broadcast, texts cross the shuffle with the part's name alone, and customers meet the orders."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = V.bookings_raw(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line.split("Inner, ")[1] for line in plan.splitlines() if "Join Inner" in line]
    at = {name: next(i for i, j in enumerate(joins) if name in j) for name in ("l_partkey", "o_custkey", "l_orderkey")}
    # The plan is printed from the top: the lines meet the orders above where they meet the parts, and orders the customers.
    assert at["l_orderkey"] < at["l_partkey"] and at["l_orderkey"] < at["o_custkey"]


def test_children_are_read_from_written_rows(spark):
    """Controls are made of the same written children, and not of the reports once more."""
    plan = Q.all_queries()["all_children"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "l_orderkey" not in plan.replace("row_ord", "")


def test_few_layouts_are_broadcast(spark, tmp_path):
    """Files of two layouts: the lines are not shuffled to learn that the table of files is small."""
    for name, sign in (("a", b"\x80"), ("b", b"\x81")):
        row = "\t".join(["C", "1", "2", "P", "L", "S", "2025-01-02"]).encode("latin-1")
        (tmp_path / f"{name}.tsv").write_bytes("\t".join(S.REQUIRED_COLUMNS).encode() + b"\n" + row.replace(b"P", sign) + b"\n")
    rows = P.read_reports(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.report_id, r.PropertyName) for r in rows.collect()) == [("a", "€"), ("b", "\x81")]


def test_outcomes_are_the_same_from_written_rows(spark):
    parents = of_parents(spark, 30).withColumns(
        {"task_name": F.lit("t"), "status": F.when(F.col("job_number") % 3 == 0, S.CREATED).otherwise(S.SKIP_EXISTS), "parent_task_gid": F.lit("g")}
    )
    children = of_parents(spark, 30).withColumns(
        {"our_ref": F.lit("1"), "subtask_name": F.lit("s"), "due": F.lit(None).cast("date"), "start_date_raw": F.lit(""),
         "subtask_kind": F.lit("source"), "child_ord": F.lit(1)}
    )
    acks = children.filter("job_number % 2 = 0").select(*S.CHILD_KEY, "subtask_name", F.lit("c").alias("gid"), F.lit(None).cast("string").alias("error"))
    want = sorted(O.child_outcomes(parents, children, acks).collect())
    assert sorted(O.child_outcomes(parents, children, acks, lambda rows: materialise(rows, "joined")).collect()) == want
    assert len(want) == 30 and sum(r.subtask_status == S.CREATED for r in want) == 5
