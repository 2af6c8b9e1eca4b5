"""Inputs of the pipeline, derived by Spark from the given tables.

Each view has a twin in ``oracle.py``. They grow with the tables: one report row per line item, one
report per 150 customers, one task per order, one message per event, one feed per customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookwright import schema as S

REPORT_CUSTOMERS = 150
EMPTY_PATH = "array<int>"

# Cell texts that a reader of whole files takes for missing; stated here apart from the engine's own list.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
# Texts that look like them and are not.
PRESENT_TEXTS = (" NA", "na", "Null", "none", "-", "NAN", "N/A ", "#n/a", "0", "nan nan", ".")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def report_number(customer: Column) -> Column:
    return F.floor(customer / REPORT_CUSTOMERS)


def bookings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows of many reports, with missing keys, repeated references and mixed dates."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")

    # What is too large to broadcast meets while rows are few or narrow, so that no join shuffles whole rows.
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    # The join with the orders needs this partitioning anyway; where they are broadcast instead,
    # it keeps a file of one row group from becoming one task.
    lines = lines.repartition("l_orderkey")
    rows = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    order = F.col("l_orderkey")
    campaign = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("   "), F.col("o_orderpriority"))
    day = F.col("l_shipdate").cast("date")
    row_ord = F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select(
        F.concat(F.lit("r"), _text(report_number(F.col("o_custkey")))).alias("report_id"),
        F.when(order % 17 == 0, "")
        .when(order % 29 == 0, "NA")
        .when(order % 2 == 1, F.concat(campaign, F.lit(", ")))
        .otherwise(campaign)
        .alias("CampaignName"),
        F.when(order % 19 == 0, "")
        .when(order % 2 == 0, F.concat(_text(order), F.lit(".0")))
        .otherwise(_text(order))
        .alias("JobNumber"),
        F.when(F.col("l_partkey") % 23 == 0, " ").otherwise(_text(F.col("l_linenumber"))).alias("OurRef"),
        F.col("s_name").alias("PropertyName"),
        F.col("n_name").alias("LocationText"),
        F.col("p_name").alias("SpecificationText"),
        F.when(F.col("l_suppkey") % 4 == 0, "TBC")
        .when(F.col("l_suppkey") % 4 == 1, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
        .alias("StartDate"),
        row_ord.alias("row_ord"),
    )


def cell_texts(key: Column) -> Column:
    """One after the other of the texts that are missing cells, and of those that are not."""
    texts = F.array(*(F.lit(t) for t in (*MISSING_TEXTS, *PRESENT_TEXTS)))
    return F.get(texts, F.pmod(key, F.lit(len(MISSING_TEXTS) + len(PRESENT_TEXTS))).cast("int"))


def existing_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task names over three projects; some blank, none trimmed."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    name = F.concat(F.lit(" Done ("), _text(key * 7), F.lit(") v"), _text(F.col("o_custkey")))
    return orders.select(
        _text(F.lit(100) + F.col("o_custkey") % 3).alias("project_gid"),
        F.when(key % 35 == 0, "").otherwise(name).alias("name"),
        key.alias("task_key"),
    )


def task_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks as response pages of at most a hundred entries, one JSON text per page.

    A page covers a hundred order keys. Every page carries one
    entry that is no object, and every seventh page a sibling without data.
    """
    tasks = existing_tasks(spark, sf_dir).withColumn("page", F.floor(F.col("task_key") / 100))
    entry = F.to_json(F.struct(_text(F.col("task_key")).alias("gid"), F.col("name").alias("name")))
    pages = tasks.groupBy("project_gid", "page").agg(F.array_join(F.collect_list(entry), ",").alias("entries"))
    following = F.concat(F.lit('{"offset":"'), _text(F.col("page") + 1), F.lit('"}'))
    full = F.concat(F.lit('{"data":['), F.col("entries"), F.lit(',"stray"],"next_page":'), following, F.lit("}"))
    empty = pages.filter(F.col("page") % 7 == 0).select("project_gid", F.lit('{"data":null,"next_page":null}').alias("value"))
    return pages.select("project_gid", full.alias("value")).unionByName(empty)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per event: subject header, labels, and whether it has an attachment."""
    e = table(spark, sf_dir, "events")
    subject = F.concat(F.lit("Booking Report - "), F.col("event_type"))

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    place = F.when(F.col("event_id") % 11 == 0, "ARCHIVE").otherwise("INBOX")
    labels = F.when(F.col("event_type") == "error", F.array(place, F.lit("Processed"))).otherwise(F.array(place))
    return e.select(
        F.concat(F.lit("u"), _text(F.col("user_id"))).alias("inbox_id"),
        F.col("event_id").alias("message_id"),
        _text(F.unix_millis(F.col("ts").cast("timestamp"))).alias("internal_date"),
        F.array(
            header("Received", F.lit("x")),
            header("SUBJECT", subject),
            header("Subject", F.lit("a later header of the same name")),
        ).alias("headers"),
        labels.alias("labels"),
        (F.col("event_id") % 13 != 0).alias("has_attachment"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five part rows per message: a root, a body, and a container with two files."""
    e = F.col("event_id")
    base = e * 10

    def node(number: int, parent: int | None, pos: int, filename: Column, att: Column) -> Column:
        above = F.lit(None).cast("bigint") if parent is None else base + parent
        return F.struct(
            (base + number).alias("part_id"),
            above.alias("parent_id"),
            F.lit(pos).alias("pos"),
            filename.alias("filename"),
            att.alias("att_id"),
        )

    none = F.lit("")
    first = F.when(e % 5 == 0, "a.tsv").when(e % 5 == 1, "a.PDF").otherwise("a.csv")
    second = F.when(e % 3 == 0, "B.XLSX").when(e % 3 == 1, "b.png").otherwise(" b.TSV ")
    nodes = F.array(
        node(0, None, 0, none, none),
        node(1, 0, 0, F.lit("body.txt"), none),
        node(2, 0, 1, none, none),
        node(3, 2, 0, first, F.concat(F.lit("x"), _text(e))),
        node(4, 2, 1, second, F.when(e % 7 == 0, "").otherwise(F.concat(F.lit("y"), _text(e)))),
    )
    return table(spark, sf_dir, "events").select(e.alias("message_id"), F.inline(nodes))


def page_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response page per order, chained within a hundred customers' orders; three of four chains have a fault.

    Each has the offset it was asked for with. A page lacks in the middle, or the first one does, or the last leads back.
    """
    orders = table(spark, sf_dir, "orders")
    group = F.floor(F.col("o_custkey") / 100)
    rank = F.row_number().over(Window.partitionBy("g").orderBy("o_orderkey"))
    n = F.count("*").over(Window.partitionBy("g"))
    pages = orders.select(group.alias("g"), "o_orderkey").withColumns({"i": rank, "n": n})
    kind, i = F.col("g") % 4, F.col("i")
    gone = ((kind == 1) & (i == 5)) | ((kind == 3) & (i == 1))
    following = F.when(i < F.col("n"), F.concat(F.lit("o"), _text(i + 1))).when(kind == 2, "o2")
    page = F.struct(
        F.when(i > 1, F.concat(F.lit("o"), _text(i))).alias("offset"),
        F.array(F.struct(_text(F.col("o_orderkey")).alias("gid"), F.concat(F.lit(" Job "), _text(F.col("o_orderkey"))).alias("name"))).alias("data"),
        F.when(following.isNotNull(), F.struct(following.alias("offset"))).alias("next_page"),
    )
    return pages.filter(~gone).select(F.concat(F.lit("p"), _text(F.col("g"))).alias("project_gid"), F.to_json(page).alias("value"))


def shared_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in two inboxes, under the same id."""
    own = messages(spark, sf_dir)
    return own.unionByName(own.withColumn("inbox_id", F.concat(F.lit("v "), "inbox_id")))


def file_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of ``shared_messages`` with their data: a tab file in a single-byte encoding, and behind it a quoted comma file.

    Of some messages the second file is empty, or no report; of some both are empty.
    """
    e = F.col("message_id")
    names = ["CampaignName", "JobNumber", "OurRef", "PropertyName", "LocationText", "SpecificationText", "StartDate"]
    cells = [F.lit("Camp"), _text(e), F.lit("1"), F.col("inbox_id"), F.lit("L"), F.lit("S"), F.lit("2025-01-02")]
    tab = F.concat(F.lit("\t".join(names) + "\r\n"), F.concat_ws("\t", *cells[:4], F.lit("\u0080 5"), *cells[5:]))
    row = F.concat_ws(",", F.lit('"Camp, ""new"""'), *cells[1:5], F.lit('"two\nlines"'), cells[6])
    comma = F.concat(F.lit(",".join(names) + "\n"), row, F.lit("\n"), row, F.lit("\n"))
    both = F.when(e % 5 == 0, F.lit("").cast("binary"))
    none = F.lit("").cast("binary")

    def node(number: int, parent: int | None, pos: int, filename: Column, att: str, content: Column) -> Column:
        above = F.lit(None).cast("bigint") if parent is None else e * 10 + parent
        data = F.rtrim(F.translate(F.base64(content), "+/\r\n", "-_"), F.lit("="))
        return F.struct(
            (e * 10 + number).alias("part_id"), above.alias("parent_id"), F.lit(pos).alias("pos"),
            filename.alias("filename"), F.lit(att).alias("att_id"), data.alias("data"),
        )

    nodes = F.array(
        node(0, None, 0, F.lit(""), "", none),
        node(1, 0, 0, F.lit(" the report.TSV"), "x", both.otherwise(F.encode(tab, "ISO-8859-1"))),
        node(2, 0, 1, F.when(e % 3 == 1, "b.png").otherwise("b.csv"), "y", F.when((e % 5 == 0) | (e % 3 == 0), none).otherwise(comma.cast("binary"))),
    )
    return shared_messages(spark, sf_dir).select("inbox_id", "message_id", F.inline(nodes))


def ack_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the task service by job: created, failed in several ways, or created without an id."""
    key = F.col("o_orderkey")
    failed = (
        F.when(key % 3 == 0, '{"errors":[{"message":"quota"}]}')
        .when(key % 3 == 1, '{"errors":[]}')
        .otherwise("<html>bad gateway</html>")
    )
    gid = F.when(key % 11 == 0, "").otherwise(F.concat(F.lit("g"), _text(key)))
    wrapped = F.concat(F.lit('{"data":{"gid":"'), gid, F.lit('"}}'))
    bare = F.concat(F.lit('{"gid":"'), gid, F.lit('"}'))
    return table(spark, sf_dir, "orders").select(
        _text(key).alias("job_number"),
        F.when(key % 7 == 0, 429).otherwise(201).alias("code"),
        F.when(key % 7 == 0, failed).when(key % 2 == 0, wrapped).otherwise(bare).alias("body"),
    )


def run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per customer, with settings as people type them."""
    key = F.col("c_custkey")
    ids = F.when(key % 4 == 0, "100, ,101").when(key % 4 == 1, "").when(key % 4 == 2, "100,abc").otherwise(" 102 ")
    flag = (
        F.when(key % 5 == 0, " ").when(key % 5 == 1, "YES").when(key % 5 == 2, "off").when(key % 5 == 3, " 1 ")
    ).otherwise("True")
    number = F.when(key % 3 == 0, "x").when(key % 3 == 1, "-5").otherwise("40")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("f"), _text(key)).alias("report_id"),
        ids.alias("dedupe_ids"),
        F.when(key % 6 == 5, "").otherwise(F.concat(F.lit(" "), _text(F.lit(900) + key % 3))).alias("target_project"),
        flag.alias("flag"),
        number.alias("num"),
    )


def report_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creation settings of the reports, taken from the customers that feed them."""
    key = report_number(F.col("c_custkey"))
    return (
        table(spark, sf_dir, "customer")
        .select(key.alias("n"))
        .distinct()
        .select(
            F.concat(F.lit("r"), _text(F.col("n"))).alias("report_id"),
            F.lit("500").alias("workspace"),
            _text(F.lit(600) + F.col("n")).alias("project_gid"),
            F.when(F.col("n") % 2 == 0, F.concat(F.lit("7"), _text(F.col("n")))).otherwise("").alias("assignee"),
        )
    )


def report_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header row of one file per order; some lack columns, one kind misspells one."""
    key = F.col("o_orderkey")
    kept = [
        F.when(key % (i + 3) != 0, name if name != "OurRef" else F.when(key % 2 == 0, name).otherwise("ourref"))
        for i, name in enumerate(S.REQUIRED_COLUMNS)
    ]
    header = F.filter(F.array(*kept, F.lit("Extra")), lambda c: c.isNotNull())
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("h"), _text(key)).alias("report_id"), header.alias("header"))


def search_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each report's jobs may already exist: listed projects, or the target project."""
    n = report_number(F.col("c_custkey"))
    listed = F.when(n % 4 == 0, "100, ,101").when(n % 4 == 1, " ").when(n % 4 == 2, " 102 ").otherwise("100,101,102")
    return (
        table(spark, sf_dir, "customer")
        .select(F.concat(F.lit("r"), _text(n)).alias("report_id"), listed.alias("dedupe_ids"), F.lit(" 101").alias("target_project"))
        .distinct()
    )
