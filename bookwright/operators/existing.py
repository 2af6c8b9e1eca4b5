"""Which jobs an existing item name contains: a substring search as equi-joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookwright.session import materialise


def name_pieces(names: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Every piece of a name that is as long as some job, with the name's other columns.

    A job is a substring of a name exactly when it equals one of these pieces, so the search
    needs neither a nested loop nor a check of candidates, and no piece can be hot: equal
    pieces collapse. The work is (characters in names) x (distinct job lengths); only starts
    from which a piece fits are listed.
    """
    others = [c for c in names.columns if c != "name"]
    sized = names.select(*others, "name", F.explode(F.array(*(F.lit(n) for n in lengths))).alias("n"))
    fits = sized.filter(F.col("n") <= F.char_length("name"))
    starts = fits.select(*others, "name", "n", F.explode(F.sequence(F.lit(1), F.char_length("name") - F.col("n") + 1)).alias("at"))
    return starts.select(*others, F.substring(F.col("name"), F.col("at"), F.col("n")).alias("job_number"))


def job_lengths(jobs: DataFrame) -> list[int]:
    """The different lengths of jobs, blank ones aside: few, however many jobs there are."""
    found = jobs.filter(F.col("job_number") != "").agg(F.sort_array(F.collect_set(F.char_length("job_number")))).first()[0]
    return found or []


#: Of jobs with more different characters than this, names are not cut at the others.
MOST_CHARACTERS = 1000


def job_characters(jobs: DataFrame) -> list[str] | None:
    """The different characters of jobs, or None where they are more than ``MOST_CHARACTERS``."""
    used = jobs.select(F.explode(F.array_distinct(F.split("job_number", ""))).alias("c")).distinct()
    characters = sorted(r["c"] for r in used.limit(MOST_CHARACTERS + 1).collect() if r["c"])
    return characters if len(characters) <= MOST_CHARACTERS else None


def cut_names(names: DataFrame, characters: Sequence[str] | None, least: int) -> DataFrame:
    """Names cut at all but ``characters`` (None: not at all): the runs of at least ``least`` characters, with the other columns.

    A job of these characters lies within one run. Texts that are no UTF-8 stay whole, as a pattern would change their bytes.
    """
    others = [c for c in names.columns if c != "name"]
    if characters is not None:
        unused = "[^" + "".join(f"\\x{{{ord(c):x}}}" for text in sorted(characters) for c in text) + "]+"
        runs = F.when(F.is_valid_utf8("name"), F.split("name", unused)).otherwise(F.array("name"))
        names = names.select(*others, F.explode(runs).alias("name"))
    return names.filter(F.char_length("name") >= least)


def held_jobs(names: DataFrame, jobs: DataFrame, lengths: Sequence[int], characters: Sequence[str] | None) -> DataFrame:
    """The ``jobs`` that a name with the same other columns contains; ``lengths`` and ``characters`` are theirs, and each row is there once.

    Pieces are made from the longest length down, each from the next longer pieces: a piece is the start of a longer one, or
    lies in the last longer one of its name. So equal pieces are cut further once, however many names and places have them,
    and a length costs no more rows than it has different pieces, besides the names' ends. Each length is written.
    """
    others = [c for c in names.columns if c != "name"]
    key = [*others, "job_number"]
    names = materialise(cut_names(names, characters, min(lengths)).distinct(), "runs")
    size = F.char_length("name")
    longer, above, held = None, None, []
    for n in sorted(lengths, reverse=True):
        last = size - n + 1
        own = names.filter(size >= n) if longer is None else names.filter((size >= n) & (size < longer))
        starts = own.select(*others, "name", last.alias("most"), F.explode(F.sequence(F.lit(1), last)).alias("at"))
        pieces = starts.select(*others, F.substring("name", F.col("at"), F.lit(n)).alias("job_number"), (F.col("at") == F.col("most")).alias("last"))
        if above is not None:
            most = longer - n + 1
            starts = above.select(*key, "last", F.explode(F.sequence(F.lit(1), F.when(F.col("last"), most).otherwise(1))).alias("at"))
            shorter = F.substring("job_number", F.col("at"), F.lit(n)).alias("job_number")
            pieces = pieces.union(starts.select(*others, shorter, (F.col("last") & (F.col("at") == most)).alias("last")))
        once = pieces.groupBy(*key).agg(F.bool_or("last").alias("last"))
        wanted = jobs.filter(F.char_length("job_number") == n).select(*key, F.lit(True).alias("held"))
        # The pieces are grouped by the key already, so a merge moves the jobs alone.
        level = once.join(wanted.hint("merge"), key, "left").select(*key, "last", F.col("held").isNotNull().alias("held"))
        above, longer = materialise(level if n > min(lengths) else level.filter("held"), "pieces"), n
        held.append(above.filter("held").select(*key))
    return reduce(DataFrame.union, held)


#: An index of pieces: a folder per length, and in it each piece once with its hash.
PIECE_SCHEMA = "key bigint, job_number string, length int"


def write_pieces(pieces: DataFrame, path: str) -> None:
    """``job_number`` of ``pieces`` as an index below ``path``."""
    rows = pieces.select(F.xxhash64("job_number").alias("key"), "job_number").distinct()
    rows.withColumn("length", F.char_length("job_number")).write.mode("overwrite").partitionBy("length").parquet(path)


def held_by_index(jobs: DataFrame, index: DataFrame) -> DataFrame:
    """The jobs that an index holds; only the folders of their lengths are read."""
    pieces = index.filter(F.col("length").isin(job_lengths(jobs))).select("key", "job_number")
    wanted = jobs.select("job_number").distinct().withColumn("key", F.xxhash64("job_number"))
    return wanted.join(pieces, ["key", "job_number"], "left_semi").select("job_number")


def existing_jobs(jobs: DataFrame, tasks: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """The jobs that some task name contains, case-sensitively; ``jobs`` must be distinct.

    A name is cut once however many tasks have it.

    With ``projects`` (``report_id, project_gid``) a report's jobs are looked for in the tasks of
    its own projects only; ``jobs`` and the result then have ``report_id, job_number``. The jobs
    should be a written table, so that their size is known and the planner picks the join.
    """
    key = ["job_number"] if projects is None else ["report_id", "job_number"]
    jobs = jobs.select(*key).filter(F.col("job_number") != "")
    lengths = job_lengths(jobs)
    if not lengths:
        return jobs
    names = tasks.filter(F.col("name") != "")
    if projects is None:
        return held_jobs(names.select("name"), jobs, lengths, job_characters(jobs))
    searched = projects.select("report_id", "project_gid").distinct()
    names = tasks_in_projects(names, searched).select("project_gid", "name")
    wanted = materialise(jobs.join(searched, "report_id"), "wanted")
    anywhere = wanted.select("project_gid", "job_number").distinct()
    found = held_jobs(names, anywhere, lengths, job_characters(jobs))
    return wanted.join(found, ["project_gid", "job_number"], "left_semi").select(*key).distinct()


def new_jobs(jobs: DataFrame, existing: DataFrame) -> DataFrame:
    return jobs.select("job_number").join(existing, "job_number", "left_anti")


def tasks_in_projects(tasks: DataFrame, project_gids: DataFrame) -> DataFrame:
    """Task rows of the configured projects; duplicates stay."""
    return tasks.join(project_gids.select("project_gid").distinct(), "project_gid", "left_semi")
