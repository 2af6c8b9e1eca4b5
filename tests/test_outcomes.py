"""Live mode states, sinks, labels."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from bookwright import schema as S
from bookwright.operators import ledger as L
from bookwright.operators import outcomes as O
from bookwright.operators import results as R
from bookwright.plans.reconcile import dry_run
from bookwright.sinks.tables import write_csv, write_intents, write_results

RAW = "report_id string, " + ", ".join(f"{c} string" for c in S.REQUIRED_COLUMNS) + ", row_ord bigint"
CHILD_ACK = "report_id string, campaign_name string, job_number string, our_ref string, subtask_name string, gid string, error string"


@pytest.fixture(scope="module")
def run(spark):
    jobs = ["10", "20", "30", "40", "50"]
    rows = [("r", 'C "q", é', j, ref, "p", "l", "s", "2025-01-06" if j != "20" else "TBC", i) for i, (j, ref) in enumerate((j, r) for j in jobs for r in "12")]
    rows.append(("r", "", "1", "1", "", "", "", "", 99))
    tasks = spark.createDataFrame([("1", "has 50")], "project_gid string, name string")
    return dry_run(spark.createDataFrame(rows, RAW), tasks, 2026)


@pytest.fixture(scope="module")
def parents(spark, run):
    acks = [("10", "g10", None), ("20", "", None), ("30", None, "API error 429: quota"), ("50", "g50", None)]
    keys = [("r", 'C "q", é', job, gid, error) for job, gid, error in acks]
    df = spark.createDataFrame(keys, "report_id string, campaign_name string, job_number string, gid string, error string")
    return O.parent_outcomes(run.parents, df)


def test_parent_outcomes(parents):
    got = {r.job_number: (r.status, r.reason, r.parent_task_gid) for r in parents.collect()}
    assert got == {
        "10": ("created", "Created parent task", "g10"),
        "20": ("created", "Created parent task", ""),
        "30": ("error_parent_create", "API error 429: quota", ""),
        "40": ("would_create", S.REASON_NEW, ""),
        "50": ("skip_exists", S.REASON_EXISTS, ""),
    }


def test_intents_leave_blank_members_out(spark, run, parents):
    feeds = spark.createDataFrame([("r", "w", "p", "")], "report_id string, workspace string, project_gid string, assignee string")
    payloads = {r.job_number: r.payload for r in O.parent_intents(run.parents, feeds).collect()}
    assert set(payloads) == {"10", "20", "30", "40"}
    assert payloads["10"] == json.dumps(
        {"workspace": "w", "name": 'C "q", é (10)', "projects": ["p"], "due_on": "2024-12-31"}, ensure_ascii=False, separators=(",", ":")
    )
    assert "due_on" not in payloads["20"] and "assignee" not in payloads["10"]
    children = O.child_intents(parents, run.children).collect()
    assert {r.job_number for r in children} == {"10"} and len(children) == 4
    assert json.loads(next(r.payload for r in children if r.our_ref == "1")) == {"name": "(1) p - l: s", "due_on": "2025-01-06"}


def test_child_outcomes(spark, run, parents):
    base = ("r", 'C "q", é', "10")
    acks = [(*base, "1", "(1) p - l: s", "c1", None), (*base, "2", "(2) p - l: s", None, "down"), (*base, "", "chase creative", "", None)]
    rows = O.child_outcomes(parents, run.children, spark.createDataFrame(acks, CHILD_ACK)).collect()
    got = {(r.parent_job_number, r.subtask_name): (r.subtask_status, r.subtask_gid, r.message) for r in rows}
    assert got[("10", "(1) p - l: s")] == ("created", "c1", "Created subtask")
    assert got[("10", "(2) p - l: s")] == ("error_subtask_create", "", "down")
    assert got[("10", "chase creative")] == ("created", "", "Created subtask")
    assert got[("10", "Check live status")] == ("would_create", "", "")
    for job in ("20", "30", "40"):
        assert got[(job, "(1) p - l: s")] == ("error_parent_not_created", "", "Parent not created successfully")
    assert got[("50", "(1) p - l: s")] == ("parent_skip_exists", "", "Skipped because parent already exists")
    counts = {(r.level, r.status): r.n for r in R.status_counts(parents, spark.createDataFrame(rows)).collect()}
    assert counts[("parent", "created")] == 2 and counts[("child", "error_parent_not_created")] == 2 + 4 + 4


def test_csv_bytes(spark, run, tmp_path):
    path = str(tmp_path / "out")
    write_results(run.tables(), path)
    files = sorted((tmp_path / "out" / "parent_task_results" / "report_id=r").glob("*.csv"))
    lines = b"".join(f.read_bytes() for f in files).decode().split("\n")
    assert lines[0] == ",".join(S.PARENT_COLUMNS)
    rows = [line for line in lines if line and line != lines[0]]
    assert rows[0] == f'"C ""q"", é (10)","C ""q"", é",10,2024-12-31,would_create,{S.REASON_NEW},'
    assert rows[1] == f'"C ""q"", é (20)","C ""q"", é",20,,would_create,{S.REASON_NEW},'
    children = "".join(f.read_text() for f in sorted((tmp_path / "out" / "subtask_results" / "report_id=r").glob("*.csv")))
    names = [line.split(",") for line in children.split("\n") if "(10)" in line]
    assert [n[-4] for n in names] == ["source", "source", "control", "control"]
    unmatched = next((tmp_path / "out" / "unmatched_items" / "report_id=r").glob("*.csv")).read_text()
    assert unmatched == "item,reason\nTrafficking rows,1 rows missing CampaignName\n"


def test_reports_without_rows_still_have_their_header(spark, run, tmp_path):
    reports = spark.createDataFrame([("r",), ("q",), ("q",)], "report_id string")
    for name, df, bare in (("some", run.unmatched, {"q"}), ("none", run.unmatched.limit(0), {"q", "r"})):
        write_csv(df, str(tmp_path / name), S.UNMATCHED_COLUMNS, ("report_id", "line"), reports=reports)
        texts = {r: [f.read_text() for f in (tmp_path / name / f"report_id={r}").glob("*.csv")] for r in "qr"}
        assert {r for r, own in texts.items() if own == ["item,reason\n"]} == bare
        assert all(len(own) == 1 for own in texts.values())


def test_intent_lines(spark, run, tmp_path):
    feeds = spark.createDataFrame([("r", "w", "p", "a")], "report_id string, workspace string, project_gid string, assignee string")
    write_intents(O.parent_intents(run.parents, feeds), str(tmp_path / "i"))
    lines = [json.loads(line) for f in (tmp_path / "i" / "report_id=r").glob("*.json") for line in f.read_text().splitlines()]
    assert sorted(line["job_number"] for line in lines) == ["10", "20", "30", "40"]
    assert json.loads(lines[0]["payload"])["assignee"] == "a"


def test_labels(spark):
    labels = spark.createDataFrame([("1", " Processed "), ("2", "processed"), ("3", "Other")], "label_id string, name string")
    wanted = spark.createDataFrame([("PROCESSED",), ("new",), ("New ",), ("other",)], "name string")
    rows = [(r.label_id, r.name) for r in L.upsert_labels(labels, wanted).collect()]
    assert sorted(rows[:3]) == [("1", " Processed "), ("2", "processed"), ("3", "Other")]
    assert rows[3:] == [(None, "New")]
    ids = {r.name: r.label_id for r in L.resolve_labels(labels, wanted).collect()}
    assert ids == {"PROCESSED": "1", "new": None, "New ": None, "other": "3"}
    with pytest.raises(Exception, match="must not be empty"):
        L.upsert_labels(labels, spark.createDataFrame([(" ",)], "name string")).collect()


def test_unprocessed(spark):
    inputs = spark.createDataFrame([("a",), ("b",)], "report_id string")
    assert [r[0] for r in L.unprocessed(inputs, inputs.filter(F.col("report_id") == "a")).collect()] == ["b"]


def test_intents_take_one_file_a_report_not_one_a_task(spark, tmp_path):
    rows = [(f"r{n % 20}", "C", str(n), "{}") for n in range(400)]
    intents = spark.createDataFrame(rows, "report_id string, campaign_name string, job_number string, payload string").repartition(8)
    write_intents(intents, str(tmp_path / "i"))
    assert len(list((tmp_path / "i").rglob("*.json"))) <= 20 + 4
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "i")).select("report_id", "job_number").collect()) == sorted((r[0], r[2]) for r in rows)


def test_a_small_table_of_many_reports_is_written_by_all_cores(spark, tmp_path):
    rows = [(f"r{i:03}", 1, S.UNMATCHED_ITEM, "1 rows missing JobNumber") for i in range(40)]
    df = spark.createDataFrame(rows, "report_id string, line int, item string, reason string")
    write_results({"unmatched_items": df}, str(tmp_path / "out"))
    parts = {p.name.split("-")[1] for p in (tmp_path / "out" / "unmatched_items").rglob("part-*.csv")}
    assert len(parts) > 1
    got = spark.read.option("header", True).csv(str(tmp_path / "out" / "unmatched_items"))
    assert got.count() == 40 and got.select("report_id").distinct().count() == 40
