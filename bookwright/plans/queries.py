"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookwright import schema as S
from bookwright.functions import dates as D
from bookwright.functions import payload as P
from bookwright.functions import text as T
from bookwright.operators import bookings as B
from bookwright.operators import children as C
from bookwright.operators import config as G
from bookwright.operators import existing as X
from bookwright.operators import inbox as I
from bookwright.operators import ledger as L
from bookwright.operators import outcomes as O
from bookwright.operators import results as R
from bookwright.plans import fixtures as V
from bookwright.plans.reconcile import Run, dry_run, interactive_run, with_source_facts
from bookwright.session import materialise, scratch_path, shuffles_removed
from bookwright.sinks.tables import CSV_OPTIONS, TABLES, write_intents, write_results
from bookwright.sources.reports import read_reports, report_conformance, report_id_of, report_status, survey_reports
from bookwright.sources.tasks import chain_pages, read_pages, read_task_pages, task_names
from bookwright.sources.tasks import page_chain_status as task_chains
from bookwright.streaming import incremental as N

Query = Callable[[SparkSession, str], DataFrame]

PIVOT_YEAR = 2026
MAX_MESSAGES = 20
OVERSIZE = 150
PREVIEW_ROWS = 30
REPORT_SIZE = 30
MOST_CANDIDATES = 250

_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _bookings(spark: SparkSession, sf: str) -> DataFrame:
    return B.normalise(V.bookings_raw(spark, sf))


def _source(spark: SparkSession, sf: str) -> DataFrame:
    return B.source_children(_bookings(spark, sf), "batch", PIVOT_YEAR)


def _children(spark: SparkSession, sf: str) -> DataFrame:
    # Both the children and, by their dates, the control children are made of it.
    return C.children_with_controls(materialise(_source(spark, sf), "source"))


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    return V.existing_tasks(spark, sf).select("project_gid", T.py_strip(F.col("name")).alias("name"))


def _run(spark: SparkSession, sf: str) -> Run:
    return dry_run(V.bookings_raw(spark, sf), _tasks(spark, sf), PIVOT_YEAR, projects=_projects(spark, sf))


def _projects(spark: SparkSession, sf: str) -> DataFrame:
    return G.projects_to_check(V.search_config(spark, sf))


def _child_table(df: DataFrame) -> DataFrame:
    return df.select("report_id", "campaign_name", *S.CHILD_COLUMNS)


def _due_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("subtask_due_on", D.iso_text(F.col("due"))).drop("due", "child_ord")


# --- sources ---------------------------------------------------------------------------------


def _drop_folder(spark: SparkSession, sf: str, extension: str, separator: str) -> str:
    """The bookings as report files, one folder per report and any number of files in it."""
    path = scratch_path(spark, "drop")
    raw = V.bookings_raw(spark, sf).select("report_id", *S.REQUIRED_COLUMNS, F.col("row_ord.l_orderkey").alias("k"))
    # Neighbouring reports share a task, so that there is not one file per report and task.
    writer = raw.repartitionByRange("report_id", "k").drop("k").write.partitionBy("report_id").options(**CSV_OPTIONS)
    with shuffles_removed(spark):
        writer.options(sep=separator, extension=extension).csv(path)
    return path


def _report_rows(df: DataFrame) -> DataFrame:
    return df.select("report_id", *S.REQUIRED_COLUMNS)


@query
def read_reports_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return _report_rows(read_reports(spark, _drop_folder(spark, sf, "tsv", "\t")))


@query
def read_reports_csv(spark: SparkSession, sf: str) -> DataFrame:
    return _report_rows(read_reports(spark, _drop_folder(spark, sf, "csv", ",")))


def _below_head(batches: Iterator[pa.RecordBatch], head: list[str], rows: bool) -> Iterator[pa.RecordBatch]:
    """``report_id, at, line`` with the head lines of every report that a task has; ``at`` is what to sort by."""
    seen: set[str | None] = set()
    names = ["report_id", "at", "line"]
    for batch in batches:
        reports, lines = batch.column(0), batch.column(1)
        new = [r for r in reports.unique().to_pylist() if r not in seen]
        seen.update(new)
        tops = [(r, i, text) for r in new for i, text in enumerate(head)]
        columns = list(zip(*tops)) or [(), (), ()]
        types = (pa.string(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        if rows:
            yield pa.RecordBatch.from_arrays([reports, pa.repeat(pa.scalar(len(head), pa.int32()), len(lines)), lines], names=names)


def _write_lines(lines: DataFrame, head: list[str], path: str, encoding: str = "UTF-8", rows: bool = True) -> None:
    """Report files made of given lines, with the head lines above them; without ``rows``, of the head alone.

    Neighbouring reports share a task, and a large report is spread over several by its pieces; so there are no more files
    than reports and tasks together.
    """
    ranged = lines.repartitionByRange("report_id", "piece").select("report_id", "line")
    placed = ranged.mapInArrow(partial(_below_head, head=head, rows=rows), "report_id string, at int, line string")
    placed = placed.sortWithinPartitions("report_id", "at").drop("at")
    options = CSV_OPTIONS | {"header": "false", "sep": "\u0001", "quote": "", "escape": "\u0002", "extension": "tsv", "encoding": encoding}
    with shuffles_removed(lines.sparkSession):
        placed.write.partitionBy("report_id").options(**options).csv(path)


def _tsv_lines(raw: DataFrame) -> DataFrame:
    line = F.concat_ws("\t", *(F.col(c) for c in S.REQUIRED_COLUMNS))
    piece = F.floor(F.col("row_ord.l_orderkey") / 8000)
    return raw.select("report_id", piece.alias("piece"), line.alias("line"))


@query
def skip_top_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Files with two lines above the header."""
    path = scratch_path(spark, "skip")
    head = ["exported by hand", "all bookings\tas of today", "\t".join(S.REQUIRED_COLUMNS)]
    _write_lines(_tsv_lines(V.bookings_raw(spark, sf)), head, path)
    return _report_rows(read_reports(spark, path, skip_top_rows=2))


@query
def encoding_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Single-byte files: byte 80 is a euro sign in code page 1252; byte 81 leaves only ISO-8859-1."""
    raw = V.bookings_raw(spark, sf)
    sign = F.when(F.col("report_id") < "r4", "\u0080é").otherwise("\u0081é")
    path = scratch_path(spark, "bytes")
    marked = raw.withColumn("PropertyName", F.concat("PropertyName", sign))
    _write_lines(_tsv_lines(marked), ["\t".join(S.REQUIRED_COLUMNS)], path, "ISO-8859-1")
    return _report_rows(read_reports(spark, path))


@query
def clean_header(spark: SparkSession, sf: str) -> DataFrame:
    """Columns named as careless exports name them."""
    raw = V.bookings_raw(spark, sf)
    careless = raw.select(
        F.col("report_id").alias(" report_id"),
        *(F.col(c).alias(f"  {c} ") for c in S.REQUIRED_COLUMNS),
        F.lit("x").alias("Unnamed: 7"),
        F.lit("y").alias(" UNNAMED: 8 "),
    )
    return B.clean_header(careless)


@query
def fill_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Every text that counts as a missing cell, and texts that do not, besides those of the bookings."""
    raw = V.bookings_raw(spark, sf).withColumn("PropertyName", V.cell_texts(F.col("row_ord.l_partkey") + F.col("row_ord.l_linenumber")))
    raw = raw.select("report_id", *S.REQUIRED_COLUMNS)
    return B.fill_missing(raw.withColumn("OurRef", F.nullif("OurRef", F.lit(" "))))


@query
def missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = report_conformance(V.report_headers(spark, sf))
    return rows.select("report_id", F.array_join("missing", ", ").alias("missing"))


@query
def rejected_reports(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of report files in seven states, one row per report; good ones may have too many candidates."""
    number = F.floor(F.col("o_custkey") / REPORT_SIZE)
    orders = V.table(spark, sf, "orders").select("o_orderkey", number.alias("n"))
    names = list(S.REQUIRED_COLUMNS)
    raw = V.bookings_raw(spark, sf).select(*names, F.col("row_ord.l_orderkey").alias("k"), F.col("row_ord.l_linenumber").alias("line_number"))
    # Written before they meet the orders again, so that the shuffles of the first joins are gone by then.
    raw = materialise(raw, "bookings").join(orders, F.col("k") == F.col("o_orderkey"))
    raw = raw.withColumn("report_id", F.concat(F.lit("h"), F.col("n").cast("string")))
    columns = [F.col(c) for c in names]
    first_lines = F.when(F.col("line_number") == 1, "\tmore").otherwise("")
    states: list[tuple[list[str], Column, bool]] = [
        (names, F.concat_ws("\t", *columns), True),
        (names[:2], F.concat_ws("\t", *columns[:2]), True),
        (names, F.concat_ws("\t", *columns), False),
        ([";".join(names)], F.concat_ws(";", *columns), True),
        ([*names, "JobNumber"], F.concat_ws("\t", *columns, F.lit("7")), True),
        (names, F.concat_ws("\t", *columns[:6], F.concat(F.lit('"'), columns[6], F.lit('"x'))), True),
        (names, F.concat(F.concat_ws("\t", *columns), first_lines), True),
    ]
    path = scratch_path(spark, "states")
    raw = materialise(raw, "states-raw")
    for i, (head, line, rows) in enumerate(states):
        lines = raw.filter(F.col("n") % len(states) == i).select("report_id", F.floor(F.col("k") / 8000).alias("piece"), line.alias("line"))
        _write_lines(lines, ["\t".join(head)], f"{path}/state={i}", rows=rows)
    survey = survey_reports(spark, path)
    parents = B.parent_candidates(B.normalise(read_reports(spark, path, survey=survey)))
    return report_status(survey.profile, parents, MOST_CANDIDATES).drop("files", "rejected_files")


@query
def oversize_reports(spark: SparkSession, sf: str) -> DataFrame:
    return B.oversize_reports(B.parent_candidates(_bookings(spark, sf)), OVERSIZE)


@query
def preview_topk(spark: SparkSession, sf: str) -> DataFrame:
    return B.preview(V.bookings_raw(spark, sf), PREVIEW_ROWS).select("report_id", "row_no", *S.REQUIRED_COLUMNS)


@query
def task_names_from_pages(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "pages")
    V.task_pages(spark, sf).write.partitionBy("project_gid").text(path)
    return read_task_pages(spark, path)


@query
def page_chain_status(spark: SparkSession, sf: str) -> DataFrame:
    """Which projects' stored pages are complete, and how many names the pages of their chain give."""
    path = scratch_path(spark, "chains")
    V.page_chains(spark, sf).write.partitionBy("project_gid").text(path)
    chained = materialise(chain_pages(read_pages(spark, path)), "chained")
    names = task_names(chained.filter("reached")).groupBy("project_gid").agg(F.count("*").alias("names"))
    return task_chains(chained).join(names, "project_gid", "left").na.fill(0, ["names"])


# --- inbox -----------------------------------------------------------------------------------


def _processed(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger: every message with a value below one."""
    events = V.table(spark, sf, "events").filter(F.col("value") < 1)
    return events.select(F.col("event_id").alias("message_id"))


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    return I.select_messages(V.messages(spark, sf), "booking report", _processed(spark, sf))


@query
def candidate_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf).select("inbox_id", "message_id")


@query
def latest_n_messages(spark: SparkSession, sf: str) -> DataFrame:
    return I.latest_messages(_selected(spark, sf), MAX_MESSAGES).select("inbox_id", "message_id", "msg_rank")


@query
def flatten_parts(spark: SparkSession, sf: str) -> DataFrame:
    leaves = I.flatten_parts(V.parts(spark, sf))
    return leaves.select("message_id", "part_id", F.array_join("path", "/").alias("path"))


@query
def attachment_filter(spark: SparkSession, sf: str) -> DataFrame:
    usable = V.parts(spark, sf).filter(T.is_report_attachment(F.col("filename"), F.col("att_id")))
    return usable.select("message_id", "part_id", T.py_strip(F.col("filename")).alias("filename"))


@query
def latest_attachment(spark: SparkSession, sf: str) -> DataFrame:
    return I.latest_attachment(V.messages(spark, sf), V.parts(spark, sf), _selected(spark, sf), MAX_MESSAGES)


@query
def attachment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the newest usable attachment of every inbox."""
    messages = V.shared_messages(spark, sf)
    chosen = I.latest_attachment(messages, V.file_parts(spark, sf), I.select_messages(messages, "booking report"), MAX_MESSAGES)
    return _report_rows(I.attachment_rows(chosen))


@query
def header_lookup(spark: SparkSession, sf: str) -> DataFrame:
    headers = F.col("headers")
    return V.messages(spark, sf).select(
        "message_id",
        P.header_value(headers, "Subject").alias("subject"),
        P.header_value(headers, "Reply-To").alias("reply_to"),
    )


@query
def received_at_iso(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.col("internal_date")
    key = F.col("message_id")
    odd = F.when(key % 10 == 0, "").when(key % 10 == 1, "soon").when(key % 10 == 2, F.concat(F.substring(ms, 1, 10), F.lit("000")))
    return V.messages(spark, sf).select("message_id", P.received_at(odd.otherwise(ms)).alias("received_at"))


@query
def payload_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts, encoded the way a mail service sends them, and back."""
    encoded = F.rtrim(F.translate(F.base64(F.col("text").cast("binary")), "+/\r\n", "-_"), F.lit("="))
    docs = V.table(spark, sf, "documents").select("doc_id", encoded.alias("data"))
    return docs.select("doc_id", P.decode_payload(F.col("data")).cast("string").alias("content"))


# --- scalar functions ------------------------------------------------------------------------


@query
def normalize_campaign(spark: SparkSession, sf: str) -> DataFrame:
    raw = V.bookings_raw(spark, sf)
    return raw.select("report_id", "CampaignName", T.normalize_campaign(F.col("CampaignName")).alias("campaign_name"))


@query
def normalize_job(spark: SparkSession, sf: str) -> DataFrame:
    raw = V.bookings_raw(spark, sf)
    return raw.select("report_id", "JobNumber", T.normalize_job(F.col("JobNumber")).alias("job_number"))


def _date_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Every order and ship date, written in twelve ways."""
    lines = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("day")
    )
    shapes = (
        "yyyy-MM-dd", "dd/MM/yyyy", "d/M/yy", "MM/dd/yyyy", "dd-MMM-yy", "d MMMM yyyy", "MMM d, yyyy", "yyyy/MM/dd",
        "yyyyMMdd", "MMM yyyy", "dd.MM.yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    which = F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(len(shapes)))
    raw = F.when(F.lit(False), "")
    for i, shape in enumerate(shapes):
        raw = raw.when(which == i, F.date_format("day", shape))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))


def _dated(rows: DataFrame, policy: str) -> DataFrame:
    return D.lookup_due_date(rows, "raw", "due_on", policy, PIVOT_YEAR).withColumn("due_on", D.iso_text(F.col("due_on")))


@query
def due_on_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(_date_shapes(spark, sf), "batch")


@query
def due_on_interactive(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(_date_shapes(spark, sf), "interactive")


@query
def subtract_weekdays(spark: SparkSession, sf: str) -> DataFrame:
    orders = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    shifted = {f"minus_{n}": D.subtract_weekdays(F.col("day"), n).cast("string") for n in (0, 1, 4, 5, 11)}
    return orders.withColumns(shifted).withColumn("day", F.col("day").cast("string"))


@query
def split_list(spark: SparkSession, sf: str) -> DataFrame:
    cfg = V.run_config(spark, sf)
    return cfg.select("report_id", F.array_join(T.split_list(F.col("dedupe_ids")), "|").alias("ids"))


@query
def as_flag(spark: SparkSession, sf: str) -> DataFrame:
    cfg = V.run_config(spark, sf)
    return cfg.select(
        "report_id",
        T.as_flag(F.col("flag"), True).alias("flag_on"),
        T.as_flag(F.col("flag"), False).alias("flag_off"),
    )


@query
def invalid_ids(spark: SparkSession, sf: str) -> DataFrame:
    bad = T.invalid_ids(T.split_list(F.col("dedupe_ids")))
    return V.run_config(spark, sf).select("report_id", F.array_join(bad, ", ").alias("invalid"))


@query
def as_positive_int(spark: SparkSession, sf: str) -> DataFrame:
    return V.run_config(spark, sf).select("report_id", T.as_positive_int(F.col("num"), 30).alias("value"))


# --- bookings --------------------------------------------------------------------------------


@query
def row_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.classify_rows(_bookings(spark, sf))
    return rows.groupBy("report_id", "row_class").agg(F.count("*").alias("n"))


@query
def parent_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return B.in_parent_order(B.parent_candidates(_bookings(spark, sf)))


@query
def unmatched_items(spark: SparkSession, sf: str) -> DataFrame:
    return B.unmatched_items(_bookings(spark, sf)).drop("line")


@query
def source_children(spark: SparkSession, sf: str) -> DataFrame:
    return _due_as_text(_source(spark, sf))


@query
def earliest_due(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.earliest_due(_source(spark, sf))
    return rows.withColumn("earliest", F.col("earliest").cast("string"))


@query
def control_children(spark: SparkSession, sf: str) -> DataFrame:
    return _due_as_text(C.control_children(C.earliest_due(_source(spark, sf))))


@query
def all_children(spark: SparkSession, sf: str) -> DataFrame:
    return _due_as_text(_children(spark, sf))


@query
def parent_due(spark: SparkSession, sf: str) -> DataFrame:
    first = B.first_rows(_bookings(spark, sf), "batch", PIVOT_YEAR)
    return C.parent_due(B.parents_of(first), C.earliest_due(B.children_of(first)))


@query
def jobs_to_check(spark: SparkSession, sf: str) -> DataFrame:
    return B.jobs_to_check(B.parent_candidates(_bookings(spark, sf))).orderBy("job_number")


# --- existence and results -------------------------------------------------------------------


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    return B.jobs_to_check(B.parent_candidates(_bookings(spark, sf)))


@query
def existing_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return X.existing_jobs(materialise(_jobs(spark, sf), "jobs"), _tasks(spark, sf))


@query
def existing_jobs_kgram(spark: SparkSession, sf: str) -> DataFrame:
    """The same search through a written index of the names' pieces, looked up by length and hash."""
    jobs = materialise(_jobs(spark, sf), "jobs")
    path = scratch_path(spark, "pieces")
    lengths = X.job_lengths(jobs)
    runs = X.cut_names(_tasks(spark, sf).select("name"), X.job_characters(jobs), min(lengths, default=0))
    X.write_pieces(X.name_pieces(runs.distinct(), lengths), path)
    return X.held_by_index(jobs, spark.read.schema(X.PIECE_SCHEMA).parquet(path))


@query
def existing_jobs_by_project(spark: SparkSession, sf: str) -> DataFrame:
    jobs = B.report_jobs(B.parent_candidates(_bookings(spark, sf)))
    return X.existing_jobs(materialise(jobs, "jobs"), _tasks(spark, sf), _projects(spark, sf))


@query
def new_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = materialise(_jobs(spark, sf), "jobs")
    return X.new_jobs(jobs, X.existing_jobs(jobs, _tasks(spark, sf)))


@query
def parent_results(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).parents


@query
def parent_results_interactive(spark: SparkSession, sf: str) -> DataFrame:
    return interactive_run(V.bookings_raw(spark, sf), _tasks(spark, sf), " 600 ", PIVOT_YEAR, _projects(spark, sf))[0]


@query
def child_results(spark: SparkSession, sf: str) -> DataFrame:
    return _child_table(_run(spark, sf).child_rows)


@query
def child_results_interactive(spark: SparkSession, sf: str) -> DataFrame:
    rows = interactive_run(V.bookings_raw(spark, sf), _tasks(spark, sf), "600", PIVOT_YEAR, _projects(spark, sf))[1]
    return rows.select("report_id", "campaign_name", *S.CHILD_COLUMNS_INTERACTIVE)


@query
def dedupe_projects(spark: SparkSession, sf: str) -> DataFrame:
    return G.projects_to_check(V.run_config(spark, sf))


@query
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).summary()


@query
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    run = _run(spark, sf)
    return R.status_counts(run.parents, run.child_rows)


def _with_facts(spark: SparkSession, sf: str, summary: DataFrame) -> DataFrame:
    """Summaries with the newest message of the inboxes that feed each report as source."""
    messages = V.messages(spark, sf).select(
        F.concat(F.lit("r"), V.report_number(F.substring("inbox_id", 2, 20).cast("bigint")).cast("string")).alias("report_id"),
        P.header_value(F.col("headers"), "subject").alias("subject"),
        "message_id",
        P.received_at(F.col("internal_date")).alias("received_at"),
        F.concat(F.lit("m"), F.col("message_id").cast("string"), F.lit(".tsv")).alias("filename"),
    )
    newest = Window.partitionBy("report_id").orderBy(F.col("received_at").desc(), "message_id")
    source = messages.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")
    projects = G.projects_to_check(
        V.report_feeds(spark, sf).select(
            "report_id", F.lit("100, 101,102").alias("dedupe_ids"), F.lit("").alias("target_project")
        )
    )
    return with_source_facts(summary, source, projects)


@query
def summary_text(spark: SparkSession, sf: str) -> DataFrame:
    return R.summary_text(_with_facts(spark, sf, _run(spark, sf).summary()))


# --- live mode -------------------------------------------------------------------------------


def _parent_acks(spark: SparkSession, sf: str, parents: DataFrame) -> DataFrame:
    waiting = parents.filter(F.col("status") == S.WOULD_CREATE).select(*S.PARENT_KEY)
    answered = V.ack_bodies(spark, sf).filter(F.col("job_number").cast("bigint") % 13 != 0)  # the others are still out
    answers = O.parse_acks(answered)
    return waiting.join(answers, "job_number").select(*S.PARENT_KEY, "gid", "error")


def _child_acks(intents: DataFrame) -> DataFrame:
    """Answers to the child intents: some fail, some have no id, some are still out."""
    n = F.length("payload") + F.length("job_number")
    gid = F.when(n % 5 == 0, F.lit(None).cast("string")).when(n % 7 == 0, "").otherwise(F.concat(F.lit("c"), "our_ref"))
    answered = intents.filter(n % 11 != 0)
    return answered.select(
        *S.CHILD_KEY, "subtask_name", gid.alias("gid"), F.when(n % 5 == 0, "API error 500: down").alias("error")
    )


def _outcomes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    run = _run(spark, sf)
    # Intents and outcomes of the children both start from the parents' outcomes.
    return materialise(O.parent_outcomes(run.parents, _parent_acks(spark, sf, run.parents)), "outcomes"), run.children


@query
def parent_intents(spark: SparkSession, sf: str) -> DataFrame:
    return O.parent_intents(_run(spark, sf).parents, V.report_feeds(spark, sf))


@query
def parent_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf)[0]


@query
def child_intents(spark: SparkSession, sf: str) -> DataFrame:
    return O.child_intents(*_outcomes(spark, sf)).drop("child_ord")


@query
def child_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    parents, children = _outcomes(spark, sf)
    acks = materialise(_child_acks(O.child_intents(parents, children)), "acks")
    return _child_table(O.child_outcomes(parents, children, acks, put_down=lambda rows: materialise(rows, "joined")))


@query
def summary_text_live(spark: SparkSession, sf: str) -> DataFrame:
    """The summaries after the calls: what was created, what failed, what is still out."""
    run = _run(spark, sf)
    parents = materialise(O.parent_outcomes(run.parents, _parent_acks(spark, sf, run.parents)), "outcomes")
    acks = materialise(_child_acks(O.child_intents(parents, run.children)), "acks")
    children = O.child_outcomes(parents, run.children, acks)
    summary = R.run_summary(run.counts, parents, children, run.unmatched)
    return R.summary_text(_with_facts(spark, sf, summary), "LIVE_CREATE")


@query
def ack_error_text(spark: SparkSession, sf: str) -> DataFrame:
    failed = V.ack_bodies(spark, sf).filter(F.col("code") >= 400)
    return failed.select("job_number", P.ack_error_text(F.col("code"), F.col("body")).alias("error"))


@query
def ack_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    done = V.ack_bodies(spark, sf).filter(F.col("code") < 400)
    return done.select("job_number", P.ack_data(F.col("body")).alias("data"))


# --- sinks and bookkeeping -------------------------------------------------------------------


@query
def write_results_csv(spark: SparkSession, sf: str) -> DataFrame:
    """All result tables written, and the child table read back."""
    return _read_back(spark, _written_results(spark, sf), "subtask_results")


def _written_results(spark: SparkSession, sf: str) -> str:
    """The result tables as files; every fourth report lacks no key, so that its unmatched table is a header alone."""
    path = scratch_path(spark, "results")
    tables = _run(spark, sf).tables()
    reports = tables["parent_task_results"].select("report_id").distinct()
    whole = F.substring("report_id", 2, 20).cast("bigint") % 4 == 0
    tables["unmatched_items"] = tables["unmatched_items"].filter(~whole)
    write_results(tables, path, reports=reports)
    return path


def _read_back(spark: SparkSession, path: str, table: str) -> DataFrame:
    columns = ", ".join(f"{c} string" for c in (*TABLES[table], "report_id"))
    return spark.read.schema(columns).options(**CSV_OPTIONS).csv(f"{path}/{table}").na.fill("")


@query
def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Of all three result tables as files: whether each report has one, its rows, and the characters in its cells."""
    path = _written_results(spark, sf)
    parts = []
    for name, columns in TABLES.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{name}")
        reports = files.select(report_id_of(F.col("_metadata.file_path")).alias("report_id")).distinct()
        rows = _read_back(spark, path, name).groupBy("report_id")
        size = F.char_length(F.concat(*(F.col(c) for c in columns)))
        counted = rows.agg(F.count("*").alias("rows"), F.sum(size).alias("characters"))
        parts.append(reports.join(counted, "report_id", "left").na.fill(0).withColumn("table", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def write_intents_json(spark: SparkSession, sf: str) -> DataFrame:
    """The parent intents written as JSON lines, and read back."""
    path = scratch_path(spark, "intents")
    write_intents(O.parent_intents(_run(spark, sf).parents, V.report_feeds(spark, sf)), path)
    return spark.read.schema("campaign_name string, job_number string, payload string, report_id string").json(path)


@query
def unprocessed_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Report rows of the orders that no ledger of finished orders names."""
    done = V.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    ledger = done.select(F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("report_id"))
    return L.unprocessed(V.report_headers(spark, sf), ledger).select("report_id")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.concat(F.lit(" Label "), (key % 97).cast("string"), F.when(key % 2 == 0, " ").otherwise(""))
    return V.table(spark, sf, "customer").select(key.cast("string").alias("label_id"), name.alias("name"))


def _wanted_labels(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_custkey")
    name = F.concat(F.when(key % 2 == 0, "LABEL ").otherwise("label "), (key % 131).cast("string"))
    return V.table(spark, sf, "orders").select(name.alias("name"))


@query
def label_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return L.upsert_labels(_labels(spark, sf), _wanted_labels(spark, sf))


@query
def label_resolve(spark: SparkSession, sf: str) -> DataFrame:
    wanted = _wanted_labels(spark, sf).distinct()
    return L.resolve_labels(_labels(spark, sf), wanted)


def _arrive(spark: SparkSession, folder: str, rows: DataFrame) -> None:
    """Report files put into a drop folder that may have some; their rows stand in the order of the bookings."""
    placed = rows.repartitionByRange("report_id", "row_ord").sortWithinPartitions("report_id", "row_ord")
    writer = placed.select("report_id", *S.REQUIRED_COLUMNS).write.mode("append").partitionBy("report_id")
    with shuffles_removed(spark):
        writer.options(**CSV_OPTIONS).options(sep="\t", extension="tsv").csv(folder)


@query
def incremental_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Two arrivals in a drop folder, each read by a stream that is then started once more without news; and the answers.

    Jobs have eight digits, so that they match whole. Some are in two reports of the first arrival, some in both
    arrivals, and some in existing names. What is counted per job does not depend on which report came first.
    """
    order = F.col("row_ord.l_orderkey")
    raw = V.bookings_raw(spark, sf).withColumn("JobNumber", F.when(F.col("JobNumber") != "", F.lpad(order.cast("string"), 8, "0")).otherwise(""))
    # The arrivals and the sorts that make their files read the bookings several times; they are joined once.
    raw = materialise(raw, "bookings")
    first = raw.filter(order % 5 != 0)
    shared = first.filter(order % 4 == 0).withColumn("report_id", F.concat(F.lit("x"), "report_id"))
    later = raw.filter(order % 3 == 0).withColumn("report_id", F.concat(F.lit("y"), "report_id"))
    names = V.table(spark, sf, "orders").filter(F.col("o_orderkey") % 14 == 0)
    names = names.select(F.lit("100").alias("project_gid"), F.concat(F.lit("Done "), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("name"))
    settings = N.Settings(lambda: names, pivot_year=PIVOT_YEAR)
    drop, check, out = (scratch_path(spark, name) for name in ("drop", "stream", "incremental"))
    for rows in (first.unionByName(shared), later):
        _arrive(spark, drop, rows)
        ledger = N.run_incremental(spark, drop, check, out, settings)
    ledger = N.run_incremental(spark, drop, check, out, settings)

    answers = O.parse_acks(V.ack_bodies(spark, sf).filter(F.col("job_number").cast("bigint") % 13 != 0))
    answers = answers.withColumn("job_number", F.lpad("job_number", 8, "0"))
    waiting = ledger.parents().filter(F.col("status") == S.WOULD_CREATE).select(*S.PARENT_KEY)
    acks = waiting.join(answers, "job_number").select(*S.PARENT_KEY, "gid", "error")
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in (*S.CHILD_KEY, "subtask_name", "gid", "error")))
    done = N.apply_acks(ledger, acks, none)
    key = ["campaign_name", "job_number"]
    status = F.col("status")
    parents = done.parents.groupBy(*key).agg(
        F.count("*").alias("reports"),
        F.count_if(status == S.SKIP_EXISTS).alias("skipped"),
        F.count_if(status == S.CREATED).alias("created"),
        F.count_if(status == S.ERROR_PARENT_CREATE).alias("failed"),
        F.count_if(status == S.WOULD_CREATE).alias("waiting"),
    )
    children = done.child_intents.groupBy(*key).agg(F.count("*").alias("child_intents"))
    return parents.join(children, key, "left").na.fill(0, ["child_intents"])
