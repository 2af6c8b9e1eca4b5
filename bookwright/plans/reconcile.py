"""The whole pipeline as one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookwright import schema as S
from bookwright.operators import bookings as B
from bookwright.operators import children as C
from bookwright.operators import existing as X
from bookwright.operators import results as R
from bookwright.session import materialise


@dataclass(frozen=True)
class Run:
    """The frames of a run, none of which goes back to the reports. ``children`` and ``parents`` are what live mode goes on with."""

    counts: DataFrame
    children: DataFrame
    parents: DataFrame
    child_rows: DataFrame
    unmatched: DataFrame

    def without(self, reports: DataFrame) -> Run:
        """The run but for some reports (``report_id``)."""
        frames = (self.counts, self.children, self.parents, self.child_rows, self.unmatched)
        return Run(*(f.join(reports, "report_id", "left_anti").select(*f.columns) for f in frames))

    def summary(self) -> DataFrame:
        return R.run_summary(self.counts, self.parents, self.child_rows, self.unmatched)

    def tables(self) -> dict[str, DataFrame]:
        """The result tables by name, as the sinks take them."""
        return {
            "parent_task_results": self.parents,
            "subtask_results": self.child_rows,
            "unmatched_items": self.unmatched,
        }


def dry_run(
    raw: DataFrame,
    tasks: DataFrame,
    pivot_year: int | None = None,
    date_policy: str = "batch",
    rules: Sequence[C.ControlRule] = C.DEFAULT_RULES,
    projects: DataFrame | None = None,
    earlier: Callable[[DataFrame], DataFrame] | None = None,
) -> Run:
    """Reports and existing tasks to result tables.

    ``projects`` (``report_id, project_gid``, see ``projects_to_check``) says where a report's jobs may
    already exist; without it they are looked for in all tasks. ``earlier`` says which of the
    jobs (``job_number``, written) any report finds besides.

    The reports are read and shuffled once, by campaign, job and reference, for the first-row rule. The
    rows left are written down with their counts; candidates, children, unmatched items and the summary read from there.
    The candidates are written too: jobs, control children and parents all come from them.
    """
    written = B.counted_first_rows(B.normalise(raw), date_policy, pivot_year)
    counts = B.report_counts(written, F.col("rows"))
    first = written.filter(F.col("row_class") == "ok")
    source = B.children_of(first)
    candidates = materialise(B.parents_of(first), "candidates")
    order_type = first.schema["row_ord"].dataType.simpleString()
    earliest = candidates.select(*S.PARENT_KEY, "earliest").filter(F.col("earliest").isNotNull())
    children = C.all_children(source, C.control_children(earliest, rules, order_type))

    existing = _existing(candidates, tasks, projects, earlier)
    due = C.due_from_earliest(F.col("earliest"), rules)
    dated = candidates.withColumn("parent_due_on", due)
    parents = materialise(R.parent_status(dated, existing), "parents")
    child_rows = R.child_results(parents, children)
    return Run(counts, children, parents, child_rows, B.unmatched_lines(counts))


def _existing(
    candidates: DataFrame,
    tasks: DataFrame,
    projects: DataFrame | None,
    earlier: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    jobs = materialise(B.jobs_to_check(candidates) if projects is None else B.report_jobs(candidates), "jobs")
    found = X.existing_jobs(jobs, tasks, projects)
    if earlier is None:
        return found
    return found.union(jobs.join(earlier(jobs), "job_number", "left_semi").select(*found.columns)).distinct()


def interactive_run(
    raw: DataFrame,
    tasks: DataFrame,
    target_project_gid: str,
    pivot_year: int | None = None,
    projects: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Parent and child tables by the interactive rules: no control children, no parent dates."""
    first = B.first_rows(B.normalise(raw), "interactive", pivot_year)
    candidates = materialise(B.parents_of(first), "candidates")
    existing = _existing(candidates, tasks, projects)
    parents = R.parent_results(candidates, existing, policy="interactive", target_project_gid=target_project_gid)
    return parents, R.child_results(parents, B.children_of(first), "interactive")


def with_source_facts(summary: DataFrame, attachments: DataFrame, projects: DataFrame) -> DataFrame:
    """The summary with what the text shows of each report's message and searched projects."""
    listed = projects.groupBy("report_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "project_gid"))), lambda p: p["project_gid"]).alias(
            "dedupe_projects"
        )
    )
    facts = attachments.select("report_id", "subject", "message_id", "received_at", "filename")
    return summary.join(facts, "report_id", "left").join(listed, "report_id", "left")
