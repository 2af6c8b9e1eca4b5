"""Run settings as a table, one row per report feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright.functions.text import py_strip, split_list


def dedupe_projects(ids: Column, target: Column) -> Column:
    """The configured projects, or the target project where none is configured."""
    listed = split_list(ids)
    fallback = py_strip(F.coalesce(target, F.lit("")))
    return F.when(F.size(listed) > 0, listed).when(fallback != "", F.array(fallback)).otherwise(listed)


def projects_to_check(run_config: DataFrame) -> DataFrame:
    """``report_id, project_gid``, one row per project to search, in configured order."""
    projects = dedupe_projects(F.col("dedupe_ids"), F.col("target_project"))
    return run_config.select("report_id", F.posexplode(projects).alias("position", "project_gid"))
