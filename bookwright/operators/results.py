"""Result tables, counters and the run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright import schema as S
from bookwright.functions.dates import iso_text


def _looked_up(parents: DataFrame, existing: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Parents with their status and its reason.

    ``existing`` has one row per job, or per report and job where reports search projects of their
    own, so the join keeps the size of the candidates. A job that many reports share makes a skewed
    partition, which AQE splits.
    """
    key = [c for c in ("report_id", "job_number") if c in existing.columns]
    found = existing.select(*key, F.lit(True).alias("_exists"))
    exists = F.coalesce(F.col("_exists"), F.lit(False))
    status = F.when(exists, S.SKIP_EXISTS).otherwise(S.WOULD_CREATE).alias("status")
    reason = F.when(exists, S.REASON_EXISTS).otherwise(S.REASON_NEW).alias("reason")
    return parents.join(found, key, "left"), status, reason


def parent_status(dated: DataFrame, existing: DataFrame) -> DataFrame:
    """Batch results of candidates that already carry ``parent_due_on``."""
    rows, status, reason = _looked_up(dated, existing)
    gid = F.lit("").alias("parent_task_gid")
    return rows.select("report_id", *S.PARENT_COLUMNS[:4], status, reason, gid)


def parent_results(
    parents: DataFrame,
    existing: DataFrame,
    due: DataFrame | None = None,
    policy: str = "batch",
    target_project_gid: str = "",
) -> DataFrame:
    """Status of every candidate; ``due`` has the ``parent_due_on`` of each, where it is wanted."""
    if policy == "interactive":
        rows, status, reason = _looked_up(parents, existing)
        target = F.lit(target_project_gid.strip()).alias("target_project_gid")
        return rows.select("report_id", *S.PARENT_COLUMNS_INTERACTIVE[:3], status, reason, target)
    if policy != "batch":
        raise ValueError(f"unknown policy {policy!r}")
    if due is None:
        dated = parents.withColumn("parent_due_on", F.lit(""))
    else:
        dated = parents.join(due, list(S.PARENT_KEY), "left").na.fill("", ["parent_due_on"])
    return parent_status(dated, existing)


def join_children(parent_rows: DataFrame, children: DataFrame, *columns: str) -> DataFrame:
    """Children with columns of their parent.

    One row per key on the parent side and no hint: AQE broadcasts the parents where they turn
    out small, and otherwise splits the partition of a parent that holds very many children.
    """
    wanted = parent_rows.select(*S.PARENT_KEY, "task_name", "status", *columns)
    return children.join(wanted, list(S.PARENT_KEY))


def child_base(joined: DataFrame, *more: Column | str) -> DataFrame:
    return joined.select(
        *S.PARENT_KEY,
        "child_ord",
        F.col("task_name").alias("parent_task_name"),
        F.col("job_number").alias("parent_job_number"),
        F.col("status").alias("parent_status"),
        "our_ref",
        "subtask_name",
        iso_text(F.col("due")).alias("subtask_due_on"),
        "start_date_raw",
        "subtask_kind",
        *more,
    )


def child_results(parent_rows: DataFrame, children: DataFrame, policy: str = "batch") -> DataFrame:
    """Dry-run status of every child; a parent without children gives no row.

    Keys and ``child_ord`` stay in front for sorting; the sinks keep the result columns only.
    """
    skipped = F.col("status") == S.SKIP_EXISTS
    status = F.when(skipped, S.PARENT_SKIP_EXISTS).otherwise(S.WOULD_CREATE).alias("subtask_status")
    rows = child_base(
        join_children(parent_rows, children),
        status,
        F.lit("").alias("subtask_gid"),
        F.lit(S.MESSAGE_DRY_RUN).alias("message"),
    )
    if policy == "batch":
        return rows
    if policy == "interactive":
        return rows.select(*S.PARENT_KEY, "child_ord", *S.CHILD_COLUMNS_INTERACTIVE)
    raise ValueError(f"unknown policy {policy!r}")


def status_counts(parent_rows: DataFrame, child_rows: DataFrame) -> DataFrame:
    """Rows per report, level and status."""
    parents = parent_rows.select("report_id", F.lit("parent").alias("level"), "status")
    children = child_rows.select("report_id", F.lit("child").alias("level"), F.col("subtask_status").alias("status"))
    return parents.unionByName(children).groupBy("report_id", "level", "status").agg(F.count("*").alias("n"))


def run_summary(counts: DataFrame, parent_rows: DataFrame, child_rows: DataFrame, unmatched: DataFrame) -> DataFrame:
    """The counters of every report.

    ``counts`` has ``report_id, rows``. The four tables become one stream of (report, counter, status) rows, so one
    aggregation with a partial step counts them all.
    """
    none = F.lit("")
    events = (
        counts.select("report_id", F.lit("row").alias("level"), none.alias("status"), F.col("rows").alias("n"))
        .unionByName(parent_rows.select("report_id", F.lit("parent").alias("level"), "status"), allowMissingColumns=True)
        .unionByName(
            child_rows.select("report_id", F.lit("child").alias("level"), F.col("subtask_status").alias("status")),
            allowMissingColumns=True,
        )
        .unionByName(unmatched.select("report_id", F.lit("unmatched").alias("level"), none.alias("status")), allowMissingColumns=True)
    )

    def counted(level: str, *statuses: str) -> Column:
        hit = F.col("level") == level
        return F.count_if(hit & F.col("status").isin(*statuses) if statuses else hit)

    return events.groupBy("report_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_parsed"),
        counted("parent").alias("parent_candidates"),
        counted("parent", S.WOULD_CREATE).alias("parent_would_create"),
        counted("parent", S.SKIP_EXISTS).alias("parent_skipped"),
        counted("parent", S.CREATED).alias("parent_created"),
        counted("parent", S.ERROR_PARENT_CREATE).alias("parent_errors"),
        counted("child").alias("subtask_rows"),
        counted("child", S.WOULD_CREATE).alias("subtask_would_create"),
        counted("child", S.CREATED).alias("subtask_created"),
        counted("child", S.ERROR_PARENT_NOT_CREATED, S.ERROR_SUBTASK_CREATE).alias("subtask_errors"),
        counted("unmatched").alias("unmatched_items"),
    )


# The lines of the summary text and the counter each one shows.
_SUMMARY_HEAD = (
    ("Source email subject", "subject"),
    ("Source email message id", "message_id"),
    ("Source email received (UTC)", "received_at"),
    ("Source attachment", "filename"),
)
_SUMMARY_COUNTERS = (
    ("Rows parsed", "rows_parsed"),
    ("Parent candidates", "parent_candidates"),
    ("Parent would create", "parent_would_create"),
    ("Parent skipped existing", "parent_skipped"),
    ("Parent created", "parent_created"),
    ("Parent creation errors", "parent_errors"),
    ("Subtask rows", "subtask_rows"),
    ("Subtask would create", "subtask_would_create"),
    ("Subtask created", "subtask_created"),
    ("Subtask errors", "subtask_errors"),
    ("Unmatched items", "unmatched_items"),
)
_SUMMARY_TITLES = {
    "DRY_RUN": "Daily Trafficking Dry Run Summary",
    "LIVE_CREATE": "Daily Trafficking Live Create Summary",
}


def summary_text(summary: DataFrame, mode: str = "DRY_RUN") -> DataFrame:
    """One text per report.

    ``summary`` is a run summary, with the columns ``subject``, ``message_id``, ``received_at``,
    ``filename`` and ``dedupe_projects`` (an array) where the run knows them.
    """
    title = _SUMMARY_TITLES[mode]

    def line(label: str, column: str) -> Column:
        value = F.coalesce(F.col(column).cast("string"), F.lit("")) if column in summary.columns else F.lit("")
        return F.concat(F.lit(label + ": "), value)

    projects = F.array_join("dedupe_projects", ", ") if "dedupe_projects" in summary.columns else F.lit("")
    lines = (
        F.lit(title),
        F.lit(""),
        *(line(*entry) for entry in _SUMMARY_HEAD),
        F.lit(f"Mode: {mode}"),
        *(line(*entry) for entry in _SUMMARY_COUNTERS),
        F.concat(F.lit("Dedupe projects checked: "), F.coalesce(projects, F.lit(""))),
        F.lit(""),
    )
    return summary.select("report_id", F.concat_ws("\n", *lines).alias("text"))
