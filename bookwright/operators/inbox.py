"""The inbox as tables: which message and which of its attachments to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookwright.functions.payload import decode_payload, header_value, received_at
from bookwright.functions.text import is_report_attachment, py_strip
from bookwright.session import ensure_checkpoint_dir, materialise
from bookwright.sources.reports import read_reports

FOUND = "found"
NO_MESSAGES = "no_messages"
NO_ATTACHMENT = "no_supported_attachment"


def select_messages(
    messages: DataFrame,
    subject_contains: str = "",
    processed: DataFrame | None = None,
    query: Column | None = None,
) -> DataFrame:
    """Messages in the inbox whose subject holds the phrase, with an attachment, not processed.

    ``query`` replaces the whole predicate. ``processed`` is a ledger of message ids.
    """
    if query is not None:
        return messages.filter(query)
    subject = F.lower(header_value(F.col("headers"), "subject"))
    labels = F.transform(F.col("labels"), F.lower)
    keep = (
        F.array_contains(labels, "inbox")
        & ~F.array_contains(labels, "processed")
        & F.contains(subject, F.lit(subject_contains.lower()))
        & F.col("has_attachment")
    )
    kept = messages.filter(keep)
    return kept if processed is None else kept.join(processed.select("message_id"), "message_id", "left_anti")


def latest_messages(messages: DataFrame, max_messages: int = 15) -> DataFrame:
    """The newest ``max_messages`` of every inbox; each map task keeps that many before the shuffle."""
    newest = Window.partitionBy("inbox_id").orderBy(
        F.col("internal_date").try_cast("bigint").desc_nulls_last(), "message_id"
    )
    return messages.withColumn("msg_rank", F.row_number().over(newest)).filter(F.col("msg_rank") <= max_messages)


def _message_key(parts: DataFrame) -> list[str]:
    """What names a message: its id, within its inbox where the parts say which that is."""
    return ["inbox_id", "message_id"] if "inbox_id" in parts.columns else ["message_id"]


def flatten_parts(parts: DataFrame) -> DataFrame:
    """The leaves of every message's part tree, with ``path``: the positions from the root down.

    Leaves are visited in reverse document order, that is by ``path`` descending. The paths of
    the containers grow by pointer doubling, so a tree of depth d takes log2(d) joins, and each
    round is cut off with a reliable checkpoint. The joins are merges: what the planner takes for the size of the parts is
    that of the files they come from, and a table it holds for small would go through the driver.
    """
    message = _message_key(parts)
    key = [*message, "part_id"]
    with_children = parts.filter(F.col("parent_id").isNotNull()).select(*message, F.col("parent_id").alias("part_id"))
    with_children = with_children.distinct()
    leaves = parts.join(with_children.hint("merge"), key, "left_anti")
    containers = parts.join(with_children.hint("merge"), key, "left_semi").select(
        *key,
        F.col("parent_id").alias("up"),
        F.when(F.col("parent_id").isNotNull(), F.array("pos")).otherwise(F.array().cast("array<int>")).alias("path"),
    )
    ensure_checkpoint_dir(parts.sparkSession)
    known = containers.checkpoint()
    # A chain is no longer than the containers of its message, and each round doubles its reach.
    most = known.groupBy(*message).count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length() + 1):
        if known.filter(F.col("up").isNotNull()).isEmpty():
            break
        above = known.select(
            *message, F.col("part_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head")
        )
        known = (
            known.join(above.hint("merge"), [*message, "up"], "left")
            .select(
                *key,
                F.col("next").alias("up"),
                F.concat(F.coalesce("head", F.array().cast("array<int>")), "path").alias("path"),
            )
            .checkpoint()
        )
    else:
        raise ValueError("the parts of a message form a cycle")
    heads = known.select(*message, F.col("part_id").alias("parent_id"), F.col("path").alias("head"))
    own = F.when(F.col("parent_id").isNotNull(), F.array("pos")).otherwise(F.array().cast("array<int>"))
    return leaves.join(heads.hint("merge"), [*message, "parent_id"], "left").select(
        *parts.columns, F.concat(F.coalesce("head", F.array().cast("array<int>")), own).alias("path")
    )


def latest_attachment(messages: DataFrame, parts: DataFrame, selected: DataFrame, max_messages: int = 15) -> DataFrame:
    """One row per inbox: its first report attachment over newest message, then leaf order.

    ``selected`` are the messages that passed the predicate. Only the parts of the newest ones
    are looked at. Where the parts have ``inbox_id``, messages of two inboxes may share an id. ``status`` tells an inbox without mail from one without a usable file. Where the
    parts have ``data``, an attachment without content is passed over and the record has the content.
    """
    newest = latest_messages(selected, max_messages)
    message = _message_key(parts)
    wanted = parts.join(newest.select(*message), message, "left_semi")
    data = F.col("data") if "data" in parts.columns else None
    content = ["data"] if "data" in parts.columns else []
    usable = flatten_parts(wanted).filter(is_report_attachment(F.col("filename"), F.col("att_id"), data))
    # The best leaf of a message comes first, so that the join carries one row per message.
    best_leaf = Window.partitionBy(*message).orderBy(F.col("path").desc())
    per_message = usable.withColumn("_n", F.row_number().over(best_leaf)).filter(F.col("_n") == 1)
    hits = newest.join(per_message.select(*message, "filename", "att_id", *content), message, "left")
    # Messages with a usable file sort first; at most max_messages rows per inbox remain here.
    best = Window.partitionBy("inbox_id").orderBy(F.col("att_id").isNull(), "msg_rank")
    first = hits.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == 1)
    inboxes = messages.select("inbox_id").distinct()
    found = F.col("att_id").isNotNull()
    status = F.when(F.col("message_id").isNull(), NO_MESSAGES).when(found, FOUND).otherwise(NO_ATTACHMENT)

    def only_found(c: Column) -> Column:
        return F.when(found, c)

    return inboxes.join(first, "inbox_id", "left").select(
        "inbox_id",
        status.alias("status"),
        only_found(F.col("message_id")).alias("message_id"),
        only_found(py_strip(F.col("filename"))).alias("filename"),
        only_found(F.col("att_id")).alias("att_id"),
        only_found(header_value(F.col("headers"), "subject")).alias("subject"),
        only_found(received_at(F.col("internal_date"))).alias("received_at"),
        *(only_found(F.col(c)).alias(c) for c in content),
    )


def _folder_name(c: Column) -> Column:
    """A text as it stands in a path, so that ``report_id_of`` gives it back."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def attachment_rows(attachments: DataFrame, skip_top_rows: int = 0) -> DataFrame:
    """The rows of the report that each inbox's attachment holds, as ``read_reports`` gives them.

    ``attachments`` are those of ``latest_attachment`` with ``data``, base64url text; the report is named as the inbox. The
    contents are read as bytes, by the rules of files, and need no folder. An attachment that is no base64 has no content.
    """
    found = attachments.filter(F.col("status") == FOUND)
    name = F.concat_ws("/", F.concat(F.lit("/report_id="), _folder_name(_folder_name("inbox_id"))), F.col("message_id").cast("string"), _folder_name("filename"))
    contents = materialise(found.select(name.alias("file_path"), decode_payload(F.col("data")).alias("content")), "attachments")
    return read_reports(attachments.sparkSession, contents, skip_top_rows)
