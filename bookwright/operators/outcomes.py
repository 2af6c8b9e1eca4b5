"""Live mode: creation intents, and what the acknowledgements make of them.

An acknowledgement row carries the keys of what it answers, ``gid`` and ``error``. It must be
unique per key; ``gid`` NULL together with an ``error`` means the call failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright import schema as S
from bookwright.functions.dates import iso_text
from bookwright.functions.payload import ack_data, ack_error_text
from bookwright.operators.results import child_base, join_children


def _optional(c: Column) -> Column:
    """Blank becomes NULL, which ``to_json`` leaves out."""
    return F.nullif(c, F.lit(""))


def parent_intents(parent_rows: DataFrame, run_config: DataFrame) -> DataFrame:
    """What to create for every parent that does not exist yet.

    ``run_config`` has one row per report: ``report_id, workspace, project_gid, assignee``.
    """
    wanted = parent_rows.filter(F.col("status") == S.WOULD_CREATE)
    rows = wanted.join(run_config.select("report_id", "workspace", "project_gid", "assignee"), "report_id")
    payload = F.struct(
        F.col("workspace").alias("workspace"),
        F.col("task_name").alias("name"),
        F.array("project_gid").alias("projects"),
        _optional(F.col("assignee")).alias("assignee"),
        _optional(F.col("parent_due_on")).alias("due_on"),
    )
    return rows.select(*S.PARENT_KEY, F.to_json(payload).alias("payload"))


def parent_outcomes(parent_rows: DataFrame, acks: DataFrame) -> DataFrame:
    """Parents after the calls: created, failed, or untouched where no answer is in yet."""
    answers = acks.select(*S.PARENT_KEY, F.lit(True).alias("_answered"), F.col("gid"), F.col("error"))
    rows = parent_rows.join(answers, list(S.PARENT_KEY), "left")
    answered = F.coalesce(F.col("_answered"), F.lit(False)) & (F.col("status") == S.WOULD_CREATE)
    created = answered & F.col("gid").isNotNull()
    status = F.when(created, S.CREATED).when(answered, S.ERROR_PARENT_CREATE).otherwise(F.col("status"))
    reason = (
        F.when(created, S.REASON_CREATED)
        .when(answered, F.coalesce(F.col("error"), F.lit("")))
        .otherwise(F.col("reason"))
    )
    return rows.select(
        "report_id",
        "task_name",
        "campaign_name",
        "job_number",
        "parent_due_on",
        status.alias("status"),
        reason.alias("reason"),
        F.when(created, F.col("gid")).otherwise("").alias("parent_task_gid"),
    )


def child_intents(parent_rows: DataFrame, children: DataFrame) -> DataFrame:
    """What to create below every parent that was created and has an id."""
    ready = parent_rows.filter((F.col("status") == S.CREATED) & (F.col("parent_task_gid") != ""))
    rows = join_children(ready, children, "parent_task_gid")
    payload = F.struct(
        F.col("subtask_name").alias("name"),
        _optional(iso_text(F.col("due"))).alias("due_on"),
    )
    return rows.select(
        *S.PARENT_KEY, "our_ref", "subtask_name", "child_ord", "parent_task_gid", F.to_json(payload).alias("payload")
    )


def child_outcomes(
    parent_rows: DataFrame, children: DataFrame, acks: DataFrame, put_down: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Children after the calls.

    Answers are keyed by parent, reference and title: a control child has no reference, a source
    child has a unique one. A child of a created parent without an answer keeps ``would_create``. ``put_down`` writes the
    children joined to their parents, so that the shuffles of that join are gone when the answers are joined.
    """
    key = [*S.CHILD_KEY, "subtask_name"]
    answers = acks.select(*key, F.lit(True).alias("_answered"), F.col("gid"), F.col("error"))
    rows = join_children(parent_rows, children, "parent_task_gid")
    if put_down is not None:
        rows = put_down(rows)
    rows = rows.join(answers, key, "left")

    parent_ready = (F.col("status") == S.CREATED) & (F.col("parent_task_gid") != "")
    answered = F.coalesce(F.col("_answered"), F.lit(False))
    created = answered & F.col("gid").isNotNull()

    def pick(skipped: str, no_parent: str, done: str, failed: Column, waiting: str) -> Column:
        return (
            F.when(F.col("status") == S.SKIP_EXISTS, skipped)
            .when(~parent_ready, no_parent)
            .when(created, done)
            .when(answered, failed)
            .otherwise(waiting)
        )

    status = pick(
        S.PARENT_SKIP_EXISTS, S.ERROR_PARENT_NOT_CREATED, S.CREATED, F.lit(S.ERROR_SUBTASK_CREATE), S.WOULD_CREATE
    )
    message = pick(
        S.MESSAGE_SKIPPED, S.MESSAGE_NO_PARENT, S.MESSAGE_CREATED, F.coalesce(F.col("error"), F.lit("")), ""
    )
    gid = F.when((F.col("status") != S.SKIP_EXISTS) & parent_ready & created, F.col("gid")).otherwise("")
    return child_base(rows, status.alias("subtask_status"), gid.alias("subtask_gid"), message.alias("message"))


def parse_acks(answers: DataFrame, prefix: str = "API error") -> DataFrame:
    """``gid`` and ``error`` from the ``code`` and ``body`` of each answer."""
    failed = F.col("code") >= 400
    gid = F.coalesce(F.get_json_object(ack_data(F.col("body")), "$.gid"), F.lit(""))
    return answers.withColumns(
        {
            "gid": F.when(~failed, gid),
            "error": F.when(failed, ack_error_text(F.col("code"), F.col("body"), prefix)),
        }
    )
