"""Inbox tables: part trees against a stack walk, and the choice of the attachment."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bookwright import schema as S
from bookwright.operators import inbox as I

PARTS = "message_id bigint, part_id bigint, parent_id bigint, pos int, filename string, att_id string"
MESSAGES = (
    "inbox_id string, message_id bigint, internal_date string, headers array<struct<name:string,value:string>>, "
    "labels array<string>, has_attachment boolean"
)


def stack_walk(children: dict, root: int) -> list[int]:
    """Leaves as a stack visits them: children pushed in order, popped from the end."""
    stack, leaves = [root], []
    while stack:
        node = stack.pop()
        if children.get(node):
            stack.extend(children[node])
        else:
            leaves.append(node)
    return leaves


def test_leaf_order_equals_the_stack_walk(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for message in range(12):
        size = [1, 2, 40][message % 3]
        children: dict[int, list[int]] = {}
        rows.append((message, message * 1000, None, 0, "", ""))
        for n in range(1, size):
            # Message 2 is one long chain, the others are bushy.
            above = message * 1000 + (n - 1 if message == 2 else rng.randrange(n))
            siblings = children.setdefault(above, [])
            rows.append((message, message * 1000 + n, above, len(siblings), f"f{n}", "a"))
            siblings.append(message * 1000 + n)
        want[message] = stack_walk(children, message * 1000)
    leaves = I.flatten_parts(spark.createDataFrame(rows, PARTS)).orderBy("message_id", F.col("path").desc()).collect()
    got: dict[int, list[int]] = {}
    for leaf in leaves:
        got.setdefault(leaf.message_id, []).append(leaf.part_id)
    assert got == want


def test_part_trees_do_not_go_through_the_driver(spark, tmp_path):
    rows = [(m, 10 * m + n, None if n == 0 else 10 * m + n - 1, 0, "", "a") for m in range(20) for n in range(4)]
    spark.createDataFrame(rows, PARTS).write.parquet(str(tmp_path / "parts"))  # small as a file, and so taken for small
    leaves = I.flatten_parts(spark.read.parquet(str(tmp_path / "parts")))
    assert leaves.count() == 20
    assert "Broadcast" not in leaves._jdf.queryExecution().toString()


def test_a_cycle_is_an_error(spark):
    rows = [(1, 1, 2, 0, "", ""), (1, 2, 1, 0, "", ""), (1, 3, 2, 0, "x.csv", "a")]
    with pytest.raises(ValueError, match="cycle"):
        I.flatten_parts(spark.createDataFrame(rows, PARTS))


@pytest.fixture
def inbox(spark):
    def message(inbox_id, message_id, date, subject="Daily Booking report", labels=("INBOX",), has=True):
        return (inbox_id, message_id, date, [("From", "x"), ("subject", subject)], list(labels), has)

    messages = [
        message("a", 1, "1000"),
        message("a", 2, "3000"),  # newest, but its file is of another kind
        message("a", 3, "2000"),
        message("a", 4, "9000", labels=("INBOX", "Processed")),
        message("a", 5, "9000", labels=("ARCHIVE",)),
        message("a", 6, "9000", subject="other"),
        message("a", 7, "9000", has=False),
        message("b", 8, "1000", subject="other"),
        message("c", 9, "1000"),
        message("d", 10, "5"),
        message("d", 11, "40"),  # newer as a number, not as a text
    ]
    parts = [
        (2, 20, None, 0, "x.pdf", "p"),
        (3, 30, None, 0, "", ""),
        (3, 31, 30, 0, "first.csv", "f"),
        (3, 32, 30, 1, " last.XLS ", "l"),
        (3, 33, 30, 2, "no_id.csv", ""),
        (1, 10, None, 0, "old.csv", "o"),
        (9, 90, None, 0, "y.doc", "q"),
        (10, 100, None, 0, "ten.tsv", "t"),
        (11, 110, None, 0, "eleven.tsv", "e"),
    ]
    return spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(parts, PARTS)


def test_latest_attachment(inbox):
    messages, parts = inbox
    selected = I.select_messages(messages, "booking REPORT")
    assert {r.message_id for r in selected.collect()} == {1, 2, 3, 9, 10, 11}
    got = {r.inbox_id: r for r in I.latest_attachment(messages, parts, selected, 15).collect()}
    assert (got["a"].status, got["a"].message_id, got["a"].filename, got["a"].att_id) == (I.FOUND, 3, "last.XLS", "l")
    assert got["a"].received_at == "1970-01-01T00:00:02+00:00" and got["a"].subject == "Daily Booking report"
    assert got["b"].status == I.NO_MESSAGES and got["b"].message_id is None
    assert got["c"].status == I.NO_ATTACHMENT and got["c"].filename is None
    assert got["d"].message_id == 11


def test_only_the_newest_messages_are_examined(inbox):
    messages, parts = inbox
    got = {r.inbox_id: r.status for r in I.latest_attachment(messages, parts, I.select_messages(messages, "report"), 1).collect()}
    assert got["a"] == I.NO_ATTACHMENT


def test_ledger_and_custom_query(spark, inbox):
    messages, _ = inbox
    ledger = spark.createDataFrame([(3,), (9,)], "message_id bigint")
    assert {r.message_id for r in I.select_messages(messages, "booking", ledger).collect()} == {1, 2, 10, 11}
    assert {r.message_id for r in I.select_messages(messages, query=F.col("message_id") < 3).collect()} == {1, 2}


def test_attachments_become_rows(spark):
    """Two inboxes share a message id; empty data and data of another kind are passed over."""
    import base64

    def data(text: str, encoding: str = "utf-8") -> str:
        return base64.urlsafe_b64encode(text.encode(encoding)).decode().rstrip("=")

    head = "\t".join(S.REQUIRED_COLUMNS)
    row = "\t{}\t1\tP\tL\tS\t2025-01-02"
    messages = [
        (box, m, str(m), [("Subject", "booking report")], ["INBOX"], True) for box, m in (("a/ +%20b", 1), ("b", 1), ("b", 2), ("c", 3), ("d", 4))
    ]
    parts = [
        ("a/ +%20b", 1, 1, None, 0, "own.tsv", "x", data(f"{head}\nCampé{row.format(1)}\n", "cp1252")),
        ("b", 1, 1, None, 0, "", "", ""),
        ("b", 1, 2, 1, 0, "old.xls", "x", data(f"{head}\r\nOld{row.format(2)}\r\n")),
        ("b", 1, 3, 1, 1, "empty.tsv", "y", ""),
        ("b", 2, 1, None, 0, "empty.csv", "x", None),
        ("c", 3, 1, None, 0, "only.tsv", "x", ""),
        ("d", 4, 1, None, 0, "broken.tsv", "x", "*no base64*"),
    ]
    columns = "inbox_id string, message_id bigint, part_id bigint, parent_id bigint, pos int, filename string, att_id string, data string"
    mail, leaves = spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(parts, columns)
    chosen = I.latest_attachment(mail, leaves, I.select_messages(mail, "booking"))
    assert {r.inbox_id: (r.status, r.message_id) for r in chosen.collect()} == {
        "a/ +%20b": (I.FOUND, 1),
        "b": (I.FOUND, 1),
        "c": (I.NO_ATTACHMENT, None),
        "d": (I.FOUND, 4),
    }
    rows = {(r.report_id, r.CampaignName, r.JobNumber) for r in I.attachment_rows(chosen).collect()}
    assert rows == {("a/ +%20b", "Campé", "1"), ("b", "Old", "2")}
