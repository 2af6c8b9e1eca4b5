"""Operators on small bookings, against a plain-Python model and under reshuffling."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bookwright import schema as S
from bookwright.operators import bookings as B
from bookwright.operators import children as C
from bookwright.operators import existing as X
from bookwright.operators import results as R
from bookwright.plans.reconcile import dry_run, interactive_run

RAW = "report_id string, " + ", ".join(f"{c} string" for c in S.REQUIRED_COLUMNS) + ", row_ord bigint"


def make_rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # One parent takes a third of all rows, and one reference most of those.
        if rng.random() < 0.34:
            campaign, job, ref = "Hot ,", "77.0", rng.choice(["1", "1", "1", "2", " 3 "])
        else:
            campaign = rng.choice(["A", " A", "A,", "B  x", "", "NA", "Ünï"])
            job = rng.choice(["1", "1.0", "2", "", "12", "None", "3.0"])
            ref = rng.choice(["1", "2", " ", "NULL", "x"])
        date = rng.choice(["TBC", "2025-03-01", "05/03/2025", "", "1 Mar 2025", "2025-02-30"])
        rows.append((f"r{rng.randrange(3)}", campaign, job, ref, f"p{i}", "l", rng.choice(["s", ""]), date, i))
    return rows


DATES = {"2025-03-01": "2025-03-01", "05/03/2025": "2025-03-05", "1 Mar 2025": "2025-03-01"}


def model(rows: list[tuple], names: list[str]) -> tuple[set, list, set]:
    """Parents, children and unmatched lines, row by row."""

    def cell(v):
        return "" if v in S.NA_TOKENS else v

    parents, children, seen, missing = {}, [], set(), {}
    for report, campaign, job, ref, prop, loc, spec, date, _ in sorted(rows, key=lambda r: r[-1]):
        campaign = " ".join(cell(campaign).strip().removesuffix(",").split(" "))
        while "  " in campaign:
            campaign = campaign.replace("  ", " ")
        job = cell(job).strip()
        job = job[:-2] if job.endswith(".0") and job[:-2].isdigit() else job
        ref = cell(ref).strip()
        if not campaign or not job:
            kind = "JobNumber" if campaign else "CampaignName"
            missing[(report, kind)] = missing.get((report, kind), 0) + 1
            continue
        key = (report, campaign, job)
        parents.setdefault(key, [])
        if ref and (*key, ref) not in seen:
            seen.add((*key, ref))
            due = DATES.get(date, "")
            parents[key].append(due)
            children.append((*key, ref, f"({ref}) {prop} - {loc}: {spec}".strip(), date, due, "source"))
    rows_out = set()
    for (report, campaign, job), dues in parents.items():
        valid = sorted(d for d in dues if d)
        parent_due = ""
        if valid:
            first = dt.date.fromisoformat(valid[0])
            back, left = first, 4
            while left:
                back -= dt.timedelta(days=1)
                left -= back.weekday() < 5
            parent_due = back.isoformat()
            for name, day in (("chase creative", back), ("Check live status", first + dt.timedelta(days=2))):
                children.append((report, campaign, job, "", name, valid[0], day.isoformat(), "control"))
        exists = any(job in n for n in names)
        rows_out.add((report, f"{campaign} ({job})", campaign, job, parent_due, "skip_exists" if exists else "would_create"))
    return rows_out, children, {(r, f"{n} rows missing {k}") for (r, k), n in missing.items()}


@pytest.fixture(scope="module")
def rows():
    return make_rows(600, 3)


NAMES = ["Old (12) item", "x77y", "", "Done (5)"]


@pytest.fixture(scope="module")
def tasks(spark):
    return spark.createDataFrame([("1", n) for n in NAMES], "project_gid string, name string")


@pytest.mark.parametrize("layout", ["as_is", "shuffled"])
def test_dry_run_equals_the_model(spark, rows, tasks, layout):
    data = list(rows)
    if layout == "shuffled":
        random.Random(1).shuffle(data)
    raw = spark.createDataFrame(data, RAW).repartition(7 if layout == "shuffled" else 1)
    run = dry_run(raw, tasks, 2026)
    parents, children, unmatched = model(rows, NAMES)
    got = {(r.report_id, r.task_name, r.campaign_name, r.job_number, r.parent_due_on, r.status) for r in run.parents.collect()}
    assert got == parents
    child_rows = run.child_rows.collect()
    assert sorted(
        (r.report_id, r.campaign_name, r.job_number, r.our_ref, r.subtask_name, r.start_date_raw, r.subtask_due_on, r.subtask_kind)
        for r in child_rows
    ) == sorted(children)
    status = {(p[0], p[2], p[3]): p[5] for p in parents}
    for r in child_rows:
        exists = status[(r.report_id, r.campaign_name, r.job_number)] == "skip_exists"
        assert r.subtask_status == ("parent_skip_exists" if exists else "would_create")
    assert {(r.report_id, r.reason) for r in run.unmatched.collect()} == unmatched
    summary = run.summary().agg(*(F.sum(c) for c in ("rows_parsed", "parent_candidates", "subtask_rows", "unmatched_items")))
    assert tuple(summary.first()) == (len(rows), len(parents), len(children), len(unmatched))


def test_operators_one_by_one_equal_the_plan(spark, rows, tasks):
    raw = spark.createDataFrame(rows, RAW)
    bookings = B.normalise(raw)
    source = B.source_children(bookings, "batch", 2026)
    candidates = B.parent_candidates(bookings)
    earliest = C.earliest_due(source)
    children = C.children_with_controls(source)
    existing = X.existing_jobs(B.jobs_to_check(candidates), tasks)
    parents = R.parent_results(candidates, existing, C.parent_due(candidates, earliest))
    run = dry_run(raw, tasks, 2026)
    assert sorted(parents.collect()) == sorted(run.parents.collect())
    assert sorted(R.child_results(parents, children).collect(), key=str) == sorted(run.child_rows.collect(), key=str)


def test_children_come_in_file_order_then_controls(spark, rows, tasks):
    ordered = C.in_child_order(dry_run(spark.createDataFrame(rows, RAW), tasks, 2026).child_rows).collect()
    keys = [(r.report_id, r.campaign_name, r.job_number) for r in ordered]
    assert keys == sorted(keys)
    for before, after in zip(ordered, ordered[1:]):
        if before.parent_task_name == after.parent_task_name and before.report_id == after.report_id:
            assert before.subtask_kind >= after.subtask_kind  # source, then control
            if after.subtask_kind == "source":
                assert before.child_ord.row_ord < after.child_ord.row_ord


def test_interactive_rules(spark, tasks):
    rows = [("r", "A", "1", "1", "p", "l", "s", "2025-01-02", 0), ("r", "A", "12", "1", "p", "l", "s", "TBC", 1)]
    parents, children = interactive_run(spark.createDataFrame(rows, RAW), tasks, " 9 ", 2026)
    assert parents.columns == ["report_id", *S.PARENT_COLUMNS_INTERACTIVE]
    assert {(r.job_number, r.status, r.target_project_gid) for r in parents.collect()} == {
        ("1", "skip_exists", "9"),
        ("12", "skip_exists", "9"),
    }
    assert {(r.our_ref, r.subtask_due_on) for r in children.collect()} == {("1", "2025-02-01"), ("1", "")}


def test_more_rules_give_more_controls(spark, tasks):
    rows = [("r", "A", "9", "1", "p", "l", "s", "2025-01-06", 0)]
    rules = (*C.DEFAULT_RULES, C.ControlRule("send report", days_after=30))
    run = dry_run(spark.createDataFrame(rows, RAW), tasks, 2026, rules=rules)
    assert {(r.subtask_name, r.subtask_due_on) for r in run.child_rows.filter("subtask_kind = 'control'").collect()} == {
        ("chase creative", "2024-12-31"),
        ("Check live status", "2025-01-08"),
        ("send report", "2025-02-05"),
    }


def test_existence_is_by_substring_and_exact(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("0123(é x") for _ in range(rng.randrange(0, 25))) for _ in range(200)]
    jobs = sorted({"".join(rng.choice("0123é ") for _ in range(rng.randrange(1, 9))) for _ in range(400)} | {"0" * 40})
    job_df = spark.createDataFrame([(j,) for j in jobs], "job_number string")
    task_df = spark.createDataFrame([("1", n) for n in names], "project_gid string, name string")
    want = {j for j in jobs if any(j in n for n in names)}
    assert want and want != set(jobs)
    found = X.existing_jobs(job_df, task_df)
    assert {r[0] for r in found.collect()} == want
    assert {r[0] for r in X.new_jobs(job_df, found).collect()} == set(jobs) - want
    assert X.existing_jobs(job_df.limit(0), task_df).count() == 0


def test_search_cuts_equal_pieces_once(spark, monkeypatch):
    written = []

    def counted(df, name, real=X.materialise):
        written.append((name, real(df, name)))
        return written[-1][1]

    monkeypatch.setattr(X, "materialise", counted)
    rng = random.Random(8)
    names = [f"Done (77{rng.randrange(100):02d}1234567) v{n % 4}" for n in range(400)]
    jobs = sorted({n[at : at + k] for n in names[:9] for k in (2, 3, 7) for at in (6, 8, 11)} | {"5555555", "98", "1 3"[:1]})
    found = X.existing_jobs(spark.createDataFrame([(j,) for j in jobs], "job_number string"), spark.createDataFrame([("1", n) for n in names], "project_gid string, name string"))
    assert {r[0] for r in found.collect()} == {j for j in jobs if any(j in n for n in names)}
    pieces = {n[at : at + k] for n in names for k in (1, 2, 3, 7) for at in range(len(n) - k + 1)}
    rows = sum(df.count() for name, df in written if name == "pieces")
    # The characters around the numbers are in no job; and what the names share is cut once.
    assert 0 < rows < len(pieces) < 400 * 4 * 12


def test_names_that_are_no_utf8_are_searched_as_they_are(spark):
    tasks = spark.sql("SELECT '1' AS project_gid, cast(x'41FF3737' AS string) AS name")
    jobs = spark.sql("SELECT explode(array('77', '78', cast(x'FF37' AS string))) AS job_number")
    found = X.existing_jobs(jobs, tasks).selectExpr("hex(cast(job_number AS binary))")
    assert {r[0] for r in found.collect()} == {"3737", "FF37"}


def test_existence_needs_no_nested_loop(spark, tasks):
    jobs = spark.createDataFrame([("1",), ("12",)], "job_number string")
    projects = spark.createDataFrame([("r", "1")], "report_id string, project_gid string")
    own = spark.createDataFrame([("r", "1"), ("s", "12")], "report_id string, job_number string")
    for df in (X.existing_jobs(jobs, tasks), X.existing_jobs(own, tasks, projects)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_reports_search_their_own_projects(spark):
    tasks = spark.createDataFrame([("1", "see (77)"), ("1", "see (77)"), ("2", "job 88x"), ("3", "")], "project_gid string, name string")
    projects = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("b", "3"), ("c", "9")], "report_id string, project_gid string")
    rows = [(r, j) for r in "abcd" for j in ("77", "8", "")]
    jobs = spark.createDataFrame(rows, "report_id string, job_number string")
    assert sorted(map(tuple, X.existing_jobs(jobs, tasks, projects).collect())) == [("a", "77"), ("b", "8")]
    raw = [(r, "C", "77", "1", "p", "l", "s", "2025-01-06", 0) for r in "ab"]
    run = dry_run(spark.createDataFrame(raw, RAW), tasks, 2026, projects=projects)
    assert {(r.report_id, r.status) for r in run.parents.collect()} == {("a", "skip_exists"), ("b", "would_create")}


def test_first_row_keeps_one_row_per_task_before_the_shuffle(spark, rows):
    plan = B.source_children(B.normalise(spark.createDataFrame(rows, RAW)))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning") == 1
    assert physical.index("WindowGroupLimit") < physical.index("Exchange hashpartitioning") < physical.rindex("WindowGroupLimit")


def test_a_hot_parent_is_split_in_the_child_join(spark, tmp_path):
    """With the thresholds lowered to test size, AQE splits the partition of one huge parent."""
    n = 60_000
    children = spark.range(n).select(
        F.lit("r").alias("report_id"),
        F.lit("c").alias("campaign_name"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("job_number"),
        F.col("id").cast("string").alias("our_ref"),
        F.sha2(F.col("id").cast("string"), 256).alias("subtask_name"),
        F.lit("").alias("start_date_raw"),
        F.lit(None).cast("date").alias("due"),
        F.lit("source").alias("subtask_kind"),
        F.struct(F.lit(0).alias("section"), F.col("id").alias("row_ord")).alias("child_ord"),
    )
    parents = children.groupBy(*S.PARENT_KEY).agg(F.first(F.lit("t")).alias("task_name"), F.first(F.lit(S.WOULD_CREATE)).alias("status"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = R.child_results(parents, children)
        assert len(joined.collect()) == n
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_header_and_guards(spark):
    df = spark.createDataFrame([("a", "b", "c")], ["  CampaignName ", "Unnamed: 3", " x"])
    assert B.clean_header(df).columns == ["CampaignName", "x"]
    with pytest.raises(ValueError, match="duplicate"):
        B.clean_header(spark.createDataFrame([("a", "b")], ["A", "A "]))
    with pytest.raises(ValueError, match="single column"):
        B.check_shape(spark.createDataFrame([("a",)], ["x"]))
    with pytest.raises(ValueError, match="OurRef, StartDate"):
        B.check_shape(spark.createDataFrame([("a",) * 5], [c for c in S.REQUIRED_COLUMNS if c not in ("OurRef", "StartDate")]))
    full = spark.createDataFrame([tuple("1234567"), tuple("1934567")], list(S.REQUIRED_COLUMNS))
    with pytest.raises(ValueError, match="no rows"):
        B.check_shape(full.limit(0))
    with pytest.raises(ValueError, match=r"\(2\) exceeds"):
        B.check_shape(full, 1)
    assert B.check_shape(full, 2) is full


def test_preview_is_the_head_of_every_report(spark, rows):
    got = B.preview(spark.createDataFrame(rows, RAW), 5).collect()
    for report in {r[0] for r in rows}:
        want = sorted(r[-1] for r in rows if r[0] == report)[:5]
        assert [r.row_ord for r in sorted(got, key=lambda r: r.row_no) if r.report_id == report] == want


def test_summary_text_without_source_facts(spark, rows, tasks):
    run = dry_run(spark.createDataFrame(rows, RAW), tasks, 2026)
    for mode, word in (("DRY_RUN", "Dry Run"), ("LIVE_CREATE", "Live Create")):
        text = R.summary_text(run.summary(), mode).first().text
        lines = text.split("\n")
        assert lines[0] == f"Daily Trafficking {word} Summary" and lines[1] == "" and lines[-1] == ""
        assert lines[6] == f"Mode: {mode}" and len(lines) == 20


@pytest.mark.parametrize("most", [0, 100])
def test_dates_are_read_once_a_text(spark, monkeypatch, most):
    """By the dictionary, or row by row where texts are too many for it: the same, and from a written table."""
    monkeypatch.setattr(B, "MOST_DATES", most)
    days = ["TBC", "2025-03-01", "05/03/2025", "", "1 Mar 2025", "05/03/2025"]
    rows = [("r", "C", str(i), "1" if i % 4 else "", "p", "l", "s", days[i % 6], i) for i in range(24)]
    first = B.counted_first_rows(B.normalise(spark.createDataFrame(rows, RAW)), "batch", 2026)
    assert {(r.job_number, str(r.due) if r.due else None) for r in first.collect()} == {
        (str(i), DATES.get(days[i % 6]) if i % 4 else None) for i in range(24)
    }
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "SortAggregate" not in plan
    assert ("BroadcastHashJoin" in plan) == (most > 0)
