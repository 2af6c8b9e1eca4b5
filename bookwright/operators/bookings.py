"""Report rows to parent candidates and first-row-wins children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookwright import schema as S
from bookwright.functions.dates import with_due_date
from bookwright.functions.text import child_title, fill_na, normalize_campaign, normalize_job, parent_title, py_strip
from bookwright.session import materialise


def clean_header(df: DataFrame) -> DataFrame:
    """Strip the column names and drop the nameless columns; no data is touched."""
    names = [name.strip() for name in df.columns]
    kept = [i for i, name in enumerate(names) if name and not name.lower().startswith("unnamed:")]
    twice = sorted({names[i] for i in kept if [names[k] for k in kept].count(names[i]) > 1})
    if twice:
        raise ValueError("duplicate column names after stripping: " + ", ".join(twice))
    return df.toDF(*(f"c{i}" for i in range(len(names)))).select(*(F.col(f"c{i}").alias(names[i]) for i in kept))


def fill_missing(df: DataFrame) -> DataFrame:
    """``""`` for null and for missing-value tokens, in every text column."""
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(*(fill_na(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns))


def missing_columns(columns: Sequence[str]) -> list[str]:
    """Required names that are absent, in declared order."""
    return [name for name in S.REQUIRED_COLUMNS if name not in columns]


def check_shape(df: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """The guards for one report: columns present, not a single column, not empty, not oversized."""
    if len(df.columns) <= 1:
        raise ValueError("parse looks wrong (single column); adjust the rows to skip")
    missing = missing_columns(df.columns)
    if missing:
        raise ValueError("report is missing required columns: " + ", ".join(missing))
    if df.isEmpty():
        raise ValueError("report has no rows")
    if max_candidates is not None:
        one_report = df if "report_id" in df.columns else df.withColumn("report_id", F.lit(""))
        one_report = one_report if "row_ord" in df.columns else one_report.withColumn("row_ord", F.lit(0))
        found = parent_candidates(normalise(one_report)).count()
        if found > max_candidates:
            raise ValueError(f"candidate count ({found}) exceeds the maximum of {max_candidates}")
    return df


def oversize_reports(parents: DataFrame, max_candidates: int = 25000) -> DataFrame:
    """Reports with more parent candidates than allowed."""
    counted = parents.groupBy("report_id").agg(F.count("*").alias("candidates"))
    return counted.filter(F.col("candidates") > max_candidates)


def preview(df: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` rows of every report. Each map task keeps ``n`` rows per report before the shuffle."""
    order = Window.partitionBy("report_id").orderBy("row_ord")
    return df.withColumn("row_no", F.row_number().over(order)).filter(F.col("row_no") <= n)


def normalise(raw: DataFrame) -> DataFrame:
    """Report columns to the normalised booking columns, in two projections.

    The second works on stripped columns, so that no rule strips a cell again for each use.
    """
    stripped = raw.select("report_id", *(py_strip(fill_na(F.col(c))).alias(c) for c in S.REQUIRED_COLUMNS), "row_ord")
    return stripped.select(
        "report_id",
        normalize_campaign(F.col("CampaignName"), stripped=True).alias("campaign_name"),
        normalize_job(F.col("JobNumber"), stripped=True).alias("job_number"),
        F.col("OurRef").alias("our_ref"),
        F.col("PropertyName").alias("property_name"),
        F.col("LocationText").alias("location_text"),
        F.col("SpecificationText").alias("specification_text"),
        F.col("StartDate").alias("start_date_raw"),
        "row_ord",
    )


def classify_rows(bookings: DataFrame) -> DataFrame:
    """Adds ``row_class``; a row missing both keys counts under the campaign only."""
    kind = F.when(F.col("campaign_name") == "", "missing_campaign").when(F.col("job_number") == "", "missing_job")
    return bookings.withColumn("row_class", kind.otherwise("ok"))


def _keyed(bookings: DataFrame) -> DataFrame:
    return bookings.filter((F.col("campaign_name") != "") & (F.col("job_number") != ""))


def parent_candidates(bookings: DataFrame) -> DataFrame:
    """One row per report, campaign and job. Duplicates collapse in the map tasks already."""
    keys = _keyed(bookings).select(*S.PARENT_KEY).distinct()
    title = parent_title(F.col("campaign_name"), F.col("job_number"))
    return keys.withColumn("task_name", title)


def in_parent_order(parents: DataFrame) -> DataFrame:
    """Report order of parent rows: by campaign, then job, as a distributed sort."""
    return parents.orderBy(*S.PARENT_KEY)


def report_counts(classified: DataFrame, rows: Column | None = None) -> DataFrame:
    """``rows`` of each report, and how many lack a ``campaign`` or a ``job``; ``rows`` weighs a line of the input."""
    n = F.lit(1) if rows is None else rows

    def of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("row_class") == kind, n)), F.lit(0))

    counts = classified.groupBy("report_id")
    return counts.agg(F.sum(n).alias("rows"), of("missing_campaign").alias("campaign"), of("missing_job").alias("job"))


def unmatched_items(bookings: DataFrame) -> DataFrame:
    """Up to two lines per report, naming how many rows lack a campaign or a job."""
    return unmatched_lines(report_counts(classify_rows(bookings)))


def unmatched_lines(counts: DataFrame) -> DataFrame:
    """As ``unmatched_items``, from ``report_counts``."""
    lines = F.array(
        F.struct(F.lit(1).alias("line"), F.col("campaign").alias("n"), F.lit(" rows missing CampaignName").alias("text")),
        F.struct(F.lit(2).alias("line"), F.col("job").alias("n"), F.lit(" rows missing JobNumber").alias("text")),
    )
    found = counts.select("report_id", F.inline(lines)).filter(F.col("n") > 0)
    reason = F.concat(F.col("n").cast("string"), F.col("text"))
    return found.select("report_id", "line", F.lit(S.UNMATCHED_ITEM).alias("item"), reason.alias("reason"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The whole first row of every key.

    The limit on the rank reaches the map side: each task keeps one row per key before the
    shuffle, so a key that holds a third of all rows sends one row per task. The hash in front
    of the keys decides nothing; it lets the sorts compare one number instead of several texts.
    """
    order_in_key = Window.partitionBy("_hash", *keys).orderBy(order)
    ranked = df.withColumn("_hash", F.xxhash64(*keys)).withColumn("_rank", F.row_number().over(order_in_key))
    return ranked.filter(F.col("_rank") == 1).drop("_rank", "_hash")


def _as_children(rows: DataFrame) -> DataFrame:
    columns = (F.col(c) for c in ("our_ref", "property_name", "location_text", "specification_text"))
    return rows.select(
        *S.CHILD_KEY,
        child_title(*columns).alias("subtask_name"),
        "start_date_raw",
        "due",
        F.lit(S.KIND_SOURCE).alias("subtask_kind"),
        F.struct(F.lit(0).alias("section"), F.col("row_ord").alias("row_ord")).alias("child_ord"),
    )


def source_children(bookings: DataFrame, date_policy: str = "batch", pivot_year: int | None = None) -> DataFrame:
    """First row per campaign, job and reference; all other columns come from that row.

    ``child_ord`` orders the children of a parent: the section, then the row order.
    """
    first = first_per_key(_keyed(bookings).filter(F.col("our_ref") != ""), S.CHILD_KEY, "row_ord")
    return _as_children(with_due_date(first, "start_date_raw", "due", date_policy, pivot_year, stripped=True))


#: As many different dates are read once each and handed to every task.
MOST_DATES = 100_000


def _written_with_dates(rows: DataFrame, date_policy: str, pivot_year: int | None) -> DataFrame:
    """``rows``, written, with the date of those that have a reference.

    Reading a date costs as much as all else that is done to a row, and dates repeat: each different text is read once. Of
    more than ``MOST_DATES`` texts, each row's is read by itself, and the rows are written with it.
    """
    rows = materialise(rows, "first-rows")
    texts = rows.select("start_date_raw").distinct()
    known = materialise(with_due_date(texts, "start_date_raw", "due", date_policy, pivot_year, stripped=True), "dates")
    if known.count() > MOST_DATES:
        rows = materialise(with_due_date(rows, "start_date_raw", "due", date_policy, pivot_year, stripped=True), "dated-rows")
    else:
        known = known.withColumnRenamed("start_date_raw", "_text")
        rows = rows.join(F.broadcast(known), F.col("start_date_raw").eqNullSafe(F.col("_text")), "left").drop("_text")
    return rows.withColumn("due", F.when(F.col("our_ref") != "", F.col("due")))


def first_rows(bookings: DataFrame, date_policy: str = "batch", pivot_year: int | None = None) -> DataFrame:
    """What candidates and children are both made of, from one shuffle, as a written table.

    As ``source_children``, but rows without a reference are kept, one per parent and with no
    date, because they too prove that the parent is there.
    """
    return _written_with_dates(first_per_key(_keyed(bookings), S.CHILD_KEY, "row_ord"), date_policy, pivot_year)


def counted_first_rows(bookings: DataFrame, date_policy: str = "batch", pivot_year: int | None = None) -> DataFrame:
    """``first_rows`` with ``row_class`` and ``rows``, the number of rows of each key, from the same pass; written too.

    Rows that lack a key are one row per report and kind, so that the report's counts need no other scan. Each map task
    sends one row per key. A report of rows without keys alone is among them too.
    """
    kept = F.col("row_class") == "ok"
    classed = classify_rows(bookings)
    keys = ("campaign_name", "job_number", "our_ref")
    classed = classed.withColumns({c: F.when(kept, F.col(c)).otherwise("") for c in keys})
    payload = [c for c in bookings.columns if c not in ("report_id", *keys, "row_ord")]
    first = F.min(F.struct("row_ord", *payload)).alias("first")
    grouped = classed.withColumn("_hash", F.xxhash64(*S.CHILD_KEY)).groupBy("_hash", "row_class", *S.CHILD_KEY)
    rows = grouped.agg(first, F.count("*").alias("rows")).select(
        *S.CHILD_KEY, *(F.col(f"first.{c}").alias(c) for c in (*payload, "row_ord")), "row_class", "rows"
    )
    return _written_with_dates(rows, date_policy, pivot_year)


def children_of(first: DataFrame) -> DataFrame:
    """The source children among ``first_rows``."""
    return _as_children(first.filter(F.col("our_ref") != ""))


def parents_of(first: DataFrame) -> DataFrame:
    """The candidates among ``first_rows``, with their earliest date."""
    rows = first.groupBy(*S.PARENT_KEY).agg(F.min("due").alias("earliest"))
    return rows.withColumn("task_name", parent_title(F.col("campaign_name"), F.col("job_number")))


def jobs_to_check(parents: DataFrame) -> DataFrame:
    """The distinct job numbers, over all reports."""
    return parents.select("job_number").distinct()


def report_jobs(parents: DataFrame) -> DataFrame:
    """The distinct job numbers of each report."""
    return parents.select("report_id", "job_number").distinct()
