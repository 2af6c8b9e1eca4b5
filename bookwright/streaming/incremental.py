"""A drop folder processed report by report, each exactly once.

All files of a report that are there when a run starts are one arrival of it; a name that comes
again later is another arrival. The file source remembers which files it has handed out; a
micro-batch counts as done only when its function returns. Which files belong to which arrival is a
table, and all arrivals of a batch are reconciled in one run, in their order. Everything a run
writes goes to folders of its own that a replay overwrites, and the processed mark is written last.

Titles asked for are searched through an index of their pieces, which only grows: a title's pieces of
a length are cut once, when it is asked for, or in the run that first has a job of that length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookwright import schema as S
from bookwright.operators import existing as X
from bookwright.operators import outcomes as O
from bookwright.operators.bookings import first_per_key
from bookwright.operators.results import child_results
from bookwright.plans.reconcile import dry_run
from bookwright.session import materialise
from bookwright.sinks.tables import write_intents, write_results
from bookwright.sources.reports import OK, OVERSIZE, Chosen, read_reports, report_id_of, report_status, survey_reports

_TEXT_PARENT = ("report_id", *S.PARENT_COLUMNS)
_PARENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("arrival", *_TEXT_PARENT)])
_CHILD_SCHEMA = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("arrival", *S.CHILD_KEY, "subtask_name", "start_date_raw", "subtask_kind")),
        T.StructField("due", T.DateType()),
        T.StructField(
            "child_ord",
            T.StructType(
                [
                    T.StructField("section", T.IntegerType()),
                    T.StructField(
                        "row_ord",
                        T.StructType(
                            [
                                T.StructField("file_path", T.StringType()),
                                T.StructField("block", T.LongType()),
                                T.StructField("line_no", T.LongType()),
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)
#: More groups than a micro-batch has; the number of a group is that of its batch times this, plus its own.
_GROUPS = 1_000_000_000
_PROCESSED_SCHEMA = T.StructType([T.StructField("report_id", T.StringType()), T.StructField("file_path", T.StringType())])
#: Pieces of the titles asked for; ``late`` ones are of titles asked for before, cut when their length first came up.
_PIECE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("job_number", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("late", T.BooleanType()),
        T.StructField("length", T.IntegerType()),
    ]
)
_LENGTH_SCHEMA = T.StructType([T.StructField("length", T.IntegerType())])
#: Between a name and the number of its arrival within a batch; stands in no file name.
_AGAIN = "\x1f"


@dataclass(frozen=True)
class Ledger:
    """The tables an incremental run keeps below its output folder, one folder per batch."""

    spark: SparkSession
    root: str

    def path(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch_id={batch_id}"

    def write(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(self.path(table, batch_id))

    def prepare(self) -> None:
        """Tables without rows, so that the first batch has something to read."""
        for table, schema in (
            ("parents", _PARENT_SCHEMA),
            ("children", _CHILD_SCHEMA),
            ("processed", _PROCESSED_SCHEMA),
            ("piece_lengths", _LENGTH_SCHEMA),
        ):
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(self.path(table, -1))
        none = T.StructType(_PIECE_SCHEMA.fields[:2])
        self.spark.createDataFrame([], none).write.mode("ignore").parquet(f"{self.path('title_pieces', -1)}/late=false/length=0")

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        return self.spark.read.schema(with_batch).parquet(f"{self.root}/{table}")

    def parents(self) -> DataFrame:
        return self._read("parents", _PARENT_SCHEMA)

    def children(self) -> DataFrame:
        return self._read("children", _CHILD_SCHEMA)

    def processed(self) -> DataFrame:
        return self._read("processed", _PROCESSED_SCHEMA)

    def lengths_before(self, batch_id: int) -> list[int]:
        """The lengths for which all earlier titles are in the index; as many as jobs have lengths."""
        known = self._read("piece_lengths", _LENGTH_SCHEMA).filter(F.col("batch_id") < batch_id)
        return sorted(r["length"] for r in known.select("length").distinct().collect())

    def write_pieces(self, pieces: DataFrame, batch_id: int, late: bool) -> None:
        X.write_pieces(pieces, f"{self.path('title_pieces', batch_id)}/late={str(late).lower()}")

    def held_before(self, jobs: DataFrame, batch_id: int) -> DataFrame:
        """The jobs that titles of earlier batches hold; a replay does not see its own.

        Where the batch has jobs of new lengths, the earlier titles are cut at those, and only at those.
        """
        added = sorted(set(X.job_lengths(jobs)) - set(self.lengths_before(batch_id)))
        if added:
            asked = self.parents().filter((F.col("batch_id") < batch_id) & (F.col("status") == S.WOULD_CREATE))
            self.write_pieces(X.name_pieces(asked.select(F.col("task_name").alias("name")), added), batch_id, late=True)
        index = self.spark.read.schema(_PIECE_SCHEMA).parquet(f"{self.root}/title_pieces")
        seen = (F.col("batch_id") < batch_id) | ((F.col("batch_id") == batch_id) & F.col("late") & F.lit(bool(added)))
        return X.held_by_index(jobs, index.filter(seen))

    def pivot_year(self, wanted: int | None) -> int:
        """The year that two-digit years are near to: as set, or that of the first run."""
        if wanted is not None:
            return wanted
        today = self.spark.range(1).select(F.year(F.current_date()).alias("year"))
        today.write.mode("ignore").parquet(f"{self.root}/pivot_year")
        return self.spark.read.parquet(f"{self.root}/pivot_year").first()["year"]


def asked_pieces(parents: DataFrame, lengths: list[int], characters: list[str] | None) -> DataFrame:
    """``title`` (a parent's number) and ``job_number``: where titles that parents would create may hold a job of these lengths.

    Titles are cut at all but the ``characters`` of jobs, so that places where no job can be give no row.
    """
    asked = parents.filter(F.col("status") == S.WOULD_CREATE)
    names = asked.select(F.xxhash64(*S.PARENT_KEY).alias("title"), F.col("task_name").alias("name"))
    return X.name_pieces(X.cut_names(names, characters, min(lengths)), lengths)


def claim_in_order(parents: DataFrame, turns: DataFrame) -> DataFrame:
    """Of the parents that reports would create, those that an earlier report's new title holds exist already.

    ``turns`` has ``report_id, turn``. A title counts only if its own parent is created, so a parent is
    decided once all the earlier titles that hold its job are; each round decides at least the
    earliest report that is still open.
    """
    named = parents.filter(F.col("status") == S.WOULD_CREATE).join(turns, "report_id")
    waiting = materialise(named.select(F.xxhash64(*S.PARENT_KEY).alias("id"), "job_number", "turn"), "waiting")
    lengths = X.job_lengths(waiting)
    if not lengths:
        return parents
    pieces = asked_pieces(parents, lengths, X.job_characters(waiting))
    titles = waiting.select(F.col("id").alias("title"), F.col("turn").alias("earlier"))
    held = pieces.join(waiting.select("id", "job_number", "turn"), "job_number").join(titles, "title")
    pairs = materialise(held.filter(F.col("earlier") < F.col("turn")).select("id", "title").distinct(), "held")
    blocked = pairs.select("id", F.lit(True).alias("blocked")).distinct()
    state = waiting.select("id").join(blocked, "id", "left").select("id", F.when(F.col("blocked").isNull(), True).alias("created"))
    state = materialise(state, "claims")
    while not state.filter(F.col("created").isNull()).isEmpty():
        seen = pairs.join(state.withColumnRenamed("id", "title"), "title").groupBy("id")
        seen = seen.agg(F.count_if("created").alias("live"), F.count_if(F.col("created").isNull()).alias("open"))
        verdict = F.when(F.col("live") > 0, False).when(F.col("open") == 0, True)
        state = materialise(state.join(seen, "id", "left").select("id", F.coalesce("created", verdict).alias("created")), "claims")
    lost = state.filter(~F.col("created")).select("id", F.lit(True).alias("_lost"))
    rows = parents.withColumn("id", F.xxhash64(*S.PARENT_KEY)).join(lost, "id", "left")
    late = (F.col("status") == S.WOULD_CREATE) & F.col("_lost").isNotNull()
    return rows.withColumns(
        {
            "status": F.when(late, S.SKIP_EXISTS).otherwise(F.col("status")),
            "reason": F.when(late, S.REASON_EXISTS).otherwise(F.col("reason")),
        }
    ).select(*parents.columns)


@dataclass(frozen=True)
class Settings:
    """What a run needs to know besides the reports.

    ``tasks`` gives the existing task names when a group starts. ``feeds`` has ``report_id,
    workspace, project_gid, assignee``; without it no intents are written. ``projects`` has ``report_id,
    project_gid``: where a report's jobs may exist; without it they may in all tasks.
    """

    tasks: Callable[[], DataFrame]
    feeds: Callable[[], DataFrame] | None = None
    projects: Callable[[], DataFrame] | None = None
    skip_top_rows: int = 0
    pivot_year: int | None = None
    date_policy: str = "batch"
    #: Reports with more parent candidates than this are rejected.
    max_candidates: int | None = None


def arrivals(files: DataFrame) -> DataFrame:
    """``arrival, report_id, turn`` and the ``file_path`` of each new file.

    The files of a ``report_id=`` folder are one report, and any other file is one of its own. The turn is the time of a
    report's first file, then its path. An arrival has the name of its report; a name that comes again in the same batch has
    its number behind it.
    """
    path = F.col("file_path")
    folder = F.regexp_extract(path, r"^(.*/report_id=[^/]+)/", 1)
    unit = F.when(folder != "", folder).otherwise(path)
    named = files.select("file_path", "modified", report_id_of(path).alias("report_id"), unit.alias("unit"))
    units = named.groupBy("report_id", "unit").agg(F.min(F.struct("modified", "file_path")).alias("turn"))
    again = F.row_number().over(Window.partitionBy("report_id").orderBy("turn"))
    number = F.when(again > 1, F.concat(F.lit(_AGAIN), again.cast("string"))).otherwise("")
    units = units.withColumn("arrival", F.concat("report_id", number))
    return named.join(units.select("unit", "arrival", "turn"), "unit").select("arrival", "report_id", "turn", "file_path", "modified")


def _own(rows: DataFrame, group: DataFrame) -> DataFrame:
    """Rows by report as rows by arrival."""
    names = group.select("arrival", "report_id").distinct()
    return rows.join(names, "report_id").drop("report_id").withColumnRenamed("arrival", "report_id")


def _names_come_again(group: DataFrame) -> bool:
    return not group.filter(F.col("arrival") != F.col("report_id")).isEmpty()


def _named(rows: DataFrame, group: DataFrame, again: bool) -> DataFrame:
    """Rows by arrival with the name of the report, and the ``arrival`` beside it."""
    if not again:
        return rows.withColumn("arrival", F.col("report_id"))
    names = group.select(F.col("arrival").alias("_arrival"), F.col("report_id").alias("_name")).distinct()
    joined = rows.join(names, F.col("report_id") == F.col("_arrival"))
    return joined.withColumns({"report_id": F.col("_name"), "arrival": F.col("_arrival")}).drop("_name", "_arrival")


def process_group(spark: SparkSession, drop_dir: str, group: DataFrame, batch_id: int, ledger: Ledger, settings: Settings) -> None:
    """Some whole arrivals: read, reconcile, write everything, then mark as processed."""
    first = group.agg(F.date_format(F.min("modified") - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    if first is None:
        return
    survey = survey_reports(spark, drop_dir, settings.skip_top_rows, Chosen(group, first))
    profile = survey.profile
    ledger.write(profile.filter(F.col("status") != OK).select("report_id", "file_path", "status", "missing"), "rejected", batch_id)

    files = group.select("file_path", "arrival")
    again = _names_come_again(group)
    raw = read_reports(spark, drop_dir, settings.skip_top_rows, survey)
    if again:
        raw = raw.join(files, F.col("row_ord.file_path") == F.col("file_path"))
        raw = raw.withColumn("report_id", F.col("arrival")).drop("arrival", "file_path")
    run = dry_run(
        raw,
        settings.tasks(),
        ledger.pivot_year(settings.pivot_year),
        settings.date_policy,
        projects=_own(settings.projects(), group) if settings.projects else None,
        earlier=lambda jobs: ledger.held_before(jobs, batch_id),
    )
    # One row per report, whatever came of it.
    of_arrival = profile.join(files, "file_path").withColumn("report_id", F.col("arrival")).drop("arrival")
    statuses = materialise(report_status(of_arrival, run.parents, settings.max_candidates), "statuses")
    ledger.write(_named(statuses, group, again), "statuses", batch_id)
    if settings.max_candidates is not None:
        run = run.without(statuses.filter(F.col("status") == OVERSIZE).select("report_id"))
    lengths = sorted({*ledger.lengths_before(batch_id), *X.job_lengths(run.parents)})
    claimed = claim_in_order(run.parents, group.select(F.col("arrival").alias("report_id"), "turn").distinct())
    claimed = materialise(claimed, "claimed")
    ledger.write(_named(claimed, group, again), "parents", batch_id)
    ledger.write(_named(run.children, group, again), "children", batch_id)
    if lengths:
        created = claimed.filter(F.col("status") == S.WOULD_CREATE).select(F.col("task_name").alias("name")).distinct()
        ledger.write_pieces(X.name_pieces(created, lengths), batch_id, late=False)
    ledger.write(spark.createDataFrame([(n,) for n in lengths], _LENGTH_SCHEMA), "piece_lengths", batch_id)

    tables = {
        "parent_task_results": claimed,
        "subtask_results": child_results(claimed, run.children),
        "unmatched_items": run.unmatched,
    }
    done = profile.filter(F.col("status") == OK).select("report_id", "file_path")
    arrived = done.select("file_path").join(files, "file_path").select(F.col("arrival").alias("report_id"))
    write_results(tables, f"{ledger.root}/results/batch_id={batch_id}", "overwrite", arrived)
    if settings.feeds is not None:
        intents = O.parent_intents(claimed, _own(settings.feeds(), group))
        write_intents(intents, f"{ledger.root}/parent_intents/batch_id={batch_id}", "overwrite")

    ledger.write(done, "processed", batch_id)


def run_incremental(
    spark: SparkSession,
    drop_dir: str,
    checkpoint: str,
    out_dir: str,
    settings: Settings,
    reports_per_batch: int | None = None,
) -> Ledger:
    """Process what is new in the drop folder, then stop.

    Every report sees the titles of all that arrived before it. All new reports are one run; with
    ``reports_per_batch``, as many at a time, to the same results.
    """
    ledger = Ledger(spark, out_dir.rstrip("/"))
    ledger.prepare()

    def process(files: DataFrame, batch_id: int) -> None:
        ledger.write(arrivals(files), "arrivals", batch_id)
        arrived = spark.read.parquet(ledger.path("arrivals", batch_id))
        if reports_per_batch is None:
            process_group(spark, drop_dir, arrived, batch_id * _GROUPS, ledger, settings)
            return
        # One row per arrival is ranked here, a name and a time.
        ranked = arrived.select("arrival", "turn").distinct().withColumn("rank", F.row_number().over(Window.orderBy("turn")) - 1)
        parts = ranked.select("arrival", F.floor(F.col("rank") / reports_per_batch).cast("int").alias("part"))
        parts = materialise(parts, "parts")
        for n in range((parts.agg(F.max("part")).first()[0] or 0) + 1):
            some = arrived.join(parts.filter(F.col("part") == n), "arrival", "left_semi")
            process_group(spark, drop_dir, materialise(some, "group"), batch_id * _GROUPS + n, ledger, settings)

    # Only names and times are read here; the contents are read by the runs, in pieces.
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .load(drop_dir)
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"))
    )
    stream = files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return ledger


@dataclass(frozen=True)
class Outcome:
    parents: DataFrame
    child_intents: DataFrame
    children: DataFrame


def apply_acks(ledger: Ledger, parent_acks: DataFrame, child_acks: DataFrame) -> Outcome:
    """Final states from the ledger and the answers so far.

    Child intents come from every acknowledged parent in the ledger, whichever run asked for it,
    so children are not lost when a run dies between a parent and its children. Answered children
    are not asked for again. A report that came several times has a row per parent: that of the arrival
    which asked for it, or else of the first; the children are those of the same arrival.
    """
    turn = F.struct((F.col("status") != S.WOULD_CREATE).alias("later"), "batch_id", F.char_length("arrival").alias("at"), "arrival")
    first = first_per_key(ledger.parents().withColumn("_turn", turn), S.PARENT_KEY, "_turn").drop("_turn")
    first = materialise(first, "first-arrivals")
    parents = O.parent_outcomes(first.drop("batch_id", "arrival"), parent_acks)
    own = first.select(*S.PARENT_KEY, "batch_id", "arrival")
    children = ledger.children().join(own, [*S.PARENT_KEY, "batch_id", "arrival"], "left_semi").drop("batch_id", "arrival")
    key = [*S.CHILD_KEY, "subtask_name"]
    open_intents = O.child_intents(parents, children).join(child_acks.select(*key), key, "left_anti")
    return Outcome(parents, open_intents, O.child_outcomes(parents, children, child_acks))
