"""Incremental runs over a drop folder: once each, in order, and safe to replay."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from bookwright import schema as S
from bookwright.streaming import incremental as N

HEAD = "\t".join(S.REQUIRED_COLUMNS)
ACK = "report_id string, campaign_name string, job_number string, gid string, error string"
CHILD_ACK = "report_id string, campaign_name string, job_number string, our_ref string, subtask_name string, gid string, error string"


def drop(folder, name: str, *rows: tuple[str, str, str]):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [f"{c}\t{j}\t{r}\tProp\tLoc\tSpec\t06/01/2025" for c, j, r in rows]
    (folder / name).write_text("\n".join([HEAD, *lines]) + "\n")


@pytest.fixture
def place(spark, tmp_path):
    tasks = lambda: spark.createDataFrame([("1", "old 900 item")], "project_gid string, name string")
    feeds = lambda: spark.createDataFrame(
        [("a", "w", "p", ""), ("b", "w", "p", ""), ("c", "w", "p", "")],
        "report_id string, workspace string, project_gid string, assignee string",
    )
    settings = N.Settings(tasks, feeds, pivot_year=2026)

    def run(per_batch: int = 1):
        return N.run_incremental(spark, str(tmp_path / "drop"), str(tmp_path / "check"), str(tmp_path / "out"), settings, per_batch)

    return tmp_path, run, settings


def states(ledger) -> dict:
    return {(r.report_id, r.job_number): r.status for r in ledger.parents().collect()}


def test_every_report_once_and_later_ones_see_earlier_titles(spark, place):
    folder, run, _ = place
    drop(folder / "drop", "a.tsv", ("Camp", "100", "1"), ("Camp", "900", "1"))
    ledger = run()
    assert states(ledger) == {("a", "100"): S.WOULD_CREATE, ("a", "900"): S.SKIP_EXISTS}
    batches = ledger.processed().select("batch_id").distinct().count()

    run()  # nothing new, nothing done
    assert ledger.processed().select("batch_id").distinct().count() == batches

    drop(folder / "drop", "b.tsv", ("Camp", "100", "2"), ("Camp", "10", "2"), ("New", "555", "1"))
    (folder / "drop" / "bad.tsv").write_text("no header here\n")
    run()
    assert {k: v for k, v in states(ledger).items() if k[0] == "b"} == {
        ("b", "100"): S.SKIP_EXISTS,
        ("b", "10"): S.SKIP_EXISTS,  # a substring of an earlier title
        ("b", "555"): S.WOULD_CREATE,
    }
    assert sorted(r.report_id for r in ledger.processed().collect()) == ["a", "b"]
    rejected = spark.read.parquet(f"{ledger.root}/rejected")
    assert [(r.report_id, r.status) for r in rejected.collect()] == [("bad", "single_column")]
    csvs = "".join(p.read_text() for p in (folder / "out" / "results").rglob("subtask_results/report_id=b/*.csv"))
    assert "New (555),555,would_create,1,(1) Prop - Loc: Spec,2025-01-06,06/01/2025,source,would_create,,Dry run" in csvs
    intents = [json.loads(x) for p in (folder / "out" / "parent_intents").rglob("*.json") for x in p.read_text().splitlines()]
    assert sorted(i["job_number"] for i in intents) == ["100", "555"]


def test_reports_of_one_batch_share_a_parent_once(spark, place):
    folder, run, _ = place
    drop(folder / "drop", "b.tsv", ("Camp", "100", "2"), ("Camp", "7", "1"))
    drop(folder / "drop", "a.tsv", ("Camp", "100", "1"))
    os.utime(folder / "drop" / "a.tsv", (2_000_000_000, 2_000_000_000))  # arrived last
    ledger = run(per_batch=10)
    assert states(ledger) == {
        ("b", "100"): S.WOULD_CREATE,
        ("b", "7"): S.WOULD_CREATE,
        ("a", "100"): S.SKIP_EXISTS,
    }


def test_a_replayed_batch_gives_the_same(spark, place, monkeypatch):
    """The first attempt dies after the parents are written, before the processed mark."""
    folder, run, settings = place
    drop(folder / "drop", "a.tsv", ("Camp", "100", "1"), ("Camp", "100", "2"))
    real = N.write_results

    def dies(*args, **kwargs):
        raise OSError("lost")

    monkeypatch.setattr(N, "write_results", dies)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(N, "write_results", real)
    ledger = run()
    assert states(ledger) == {("a", "100"): S.WOULD_CREATE}
    assert ledger.children().count() == 4
    assert [r.report_id for r in ledger.processed().collect()] == ["a"]


def test_children_come_from_acknowledged_parents_of_any_run(spark, place):
    folder, run, _ = place
    drop(folder / "drop", "a.tsv", ("Camp", "100", "1"))
    run()
    drop(folder / "drop", "b.tsv", ("Camp", "100", "2"), ("Camp", "200", "1"))
    ledger = run()
    parent_acks = spark.createDataFrame([("a", "Camp", "100", "g1", None), ("b", "Camp", "200", None, "down")], ACK)
    none = spark.createDataFrame([], CHILD_ACK)
    first = N.apply_acks(ledger, parent_acks, none)
    names = {r.subtask_name for r in first.child_intents.collect()}
    assert names == {"(1) Prop - Loc: Spec", "chase creative", "Check live status"}
    assert {(r.report_id, r.job_number): r.status for r in first.parents.collect()} == {
        ("a", "100"): S.CREATED,
        ("b", "100"): S.SKIP_EXISTS,
        ("b", "200"): S.ERROR_PARENT_CREATE,
    }
    done = spark.createDataFrame([("a", "Camp", "100", "1", "(1) Prop - Loc: Spec", "c1", None)], CHILD_ACK)
    second = N.apply_acks(ledger, parent_acks, done)
    assert {r.subtask_name for r in second.child_intents.collect()} == {"chase creative", "Check live status"}
    assert second.children.filter(F.col("subtask_status") == S.CREATED).count() == 1


def fill(folder):
    """Three reports, one of them in two files; a later day brings one of the names again."""
    (folder / "report_id=r1").mkdir(parents=True)
    head = [HEAD]
    (folder / "report_id=r1" / "part-0.tsv").write_text("\n".join([*head, "Camp\t100\t1\tProp\tLoc\tSpec\t07/01/2025"]) + "\n")
    (folder / "report_id=r1" / "part-1.tsv").write_text("\n".join([*head, "Camp\t100\t2\tProp\tLoc\tSpec\t06/01/2025"]) + "\n")
    drop(folder, "b.tsv", ("Camp", "10", "1"), ("Tour 5", "222", "1"))
    drop(folder / "day1", "a.tsv", ("Camp", "5", "1"), ("Camp", "300", "1"))
    drop(folder / "day2", "a.tsv", ("Camp", "300", "7"), ("Camp", "400", "1"), ("Camp", "30", "1"))
    for i, name in enumerate(("report_id=r1/part-0.tsv", "report_id=r1/part-1.tsv", "b.tsv", "day1/a.tsv", "day2/a.tsv")):
        os.utime(folder / name, (2_000_000_000 + 10 * i,) * 2)


@pytest.mark.parametrize("per_batch", [1, 2, 10])
def test_results_do_not_depend_on_the_batch_size(spark, place, per_batch):
    folder, run, _ = place
    fill(folder / "drop")
    ledger = run(per_batch)
    rows = [(r.report_id, r.job_number, r.status, r.parent_due_on) for r in ledger.parents().orderBy("batch_id").collect()]
    assert sorted(rows) == sorted(
        [
            ("r1", "100", S.WOULD_CREATE, "2024-12-31"),
            ("b", "10", S.SKIP_EXISTS, "2024-12-31"),  # held by the title of job 100
            ("b", "222", S.WOULD_CREATE, "2024-12-31"),
            ("a", "5", S.SKIP_EXISTS, "2024-12-31"),  # held by the title "Tour 5 (222)"
            ("a", "300", S.WOULD_CREATE, "2024-12-31"),
            ("a", "300", S.SKIP_EXISTS, "2024-12-31"),
            ("a", "400", S.WOULD_CREATE, "2024-12-31"),
            ("a", "30", S.SKIP_EXISTS, "2024-12-31"),
        ]
    )
    acks = [("r1", "Camp", "100", "g1", None), ("a", "Camp", "300", "g2", None)]
    out = N.apply_acks(ledger, spark.createDataFrame(acks, ACK), spark.createDataFrame([], CHILD_ACK))
    intents = sorted((r.report_id, r.job_number, r.our_ref, r.subtask_name) for r in out.child_intents.collect())
    controls = ("Check live status", "chase creative")
    assert intents == sorted(
        [("r1", "100", "1", "(1) Prop - Loc: Spec"), ("r1", "100", "2", "(2) Prop - Loc: Spec"), ("a", "300", "1", "(1) Prop - Loc: Spec")]
        + [(r, j, "", name) for r, j in (("r1", "100"), ("a", "300")) for name in controls]
    )
    assert out.parents.count() == 7 and out.children.count() == out.children.select(*S.CHILD_KEY, "subtask_name").distinct().count()


def test_a_title_that_is_not_created_holds_nothing(spark):
    columns = ("report_id", *S.PARENT_COLUMNS)
    rows = [("r1", "Camp (100)", "Camp", "100"), ("r2", "Camp 7 (10)", "Camp 7", "10"), ("r3", "X (7)", "X", "7"), ("r4", "Y (7)", "Y", "7")]
    df = spark.createDataFrame([(*r, "", S.WOULD_CREATE, S.REASON_NEW, "") for r in rows], ", ".join(f"{c} string" for c in columns))
    turns = spark.createDataFrame([(f"r{i}", i) for i in range(1, 5)], "report_id string, turn int")
    got = {r.report_id: r.status for r in N.claim_in_order(df, turns).collect()}
    assert got == {"r1": S.WOULD_CREATE, "r2": S.SKIP_EXISTS, "r3": S.WOULD_CREATE, "r4": S.SKIP_EXISTS}


def pieces_written(spark, ledger) -> dict:
    """Batch and lateness to the lengths of the pieces in the index, and their number."""
    index = spark.read.schema(N._PIECE_SCHEMA).parquet(f"{ledger.root}/title_pieces")
    rows = index.groupBy("batch_id", "late").agg(F.sort_array(F.collect_set("length")).alias("l"), F.count("*").alias("n")).collect()
    return {(r.batch_id, r.late): (r.l, r.n) for r in rows}


def test_earlier_titles_are_not_cut_again(spark, place):
    folder, run, _ = place
    drop(folder / "drop", "a.tsv", ("Camp", "100", "1"), ("Tour", "2345", "1"))
    first = pieces_written(spark, run())
    titles = ["Camp (100)", "Tour (2345)"]
    cut = lambda names, lengths: {t[i : i + n] for t in names for n in lengths for i in range(len(t) - n + 1)}
    assert first == {(0, False): ([3, 4], len(cut(titles, [3, 4])))}

    drop(folder / "drop", "b.tsv", ("Other", "777", "1"), ("Camp", "100", "1"))  # no new length
    second = pieces_written(spark, run())
    added = {k: v for k, v in second.items() if k not in first}
    assert list(added.values()) == [([3, 4], len(cut(["Other (777)"], [3, 4])))]

    drop(folder / "drop", "c.tsv", ("New", "34", "1"))  # a length that no job had before
    ledger = run()
    third = pieces_written(spark, ledger)
    late = [v for (batch, is_late), v in third.items() if is_late]
    assert late == [([2], len(cut([*titles, "Other (777)"], [2])))]
    assert states(ledger)["c", "34"] == S.SKIP_EXISTS  # in the title of job 2345


def test_statuses_of_all_reports(spark, place):
    folder, _, settings = place
    drop(folder / "drop", "a.tsv", ("Camp", "1", "1"), ("Camp", "2", "1"), ("Camp", "3", "1"))
    drop(folder / "drop", "b.tsv", ("Camp", "888", "1"))
    drop(folder / "drop", "empty.tsv")
    (folder / "drop" / "bad.tsv").write_text("no header here\n")
    from dataclasses import replace

    paths = [str(folder / n) for n in ("drop", "check", "out")]
    ledger = N.run_incremental(spark, *paths, replace(settings, max_candidates=2))
    got = {r.report_id: r.status for r in spark.read.parquet(f"{ledger.root}/statuses").collect()}
    assert got == {"a": "too_many_candidates", "b": "ok", "empty": "no_rows", "bad": "single_column"}
    assert states(ledger) == {("b", "888"): S.WOULD_CREATE}


def test_claims_look_only_where_a_job_can_be(spark):
    """Titles are cut at the characters that no job has; beyond as many characters, they are not."""
    row = ("r", "Campaign of A-77 (12345)", "Campaign of A-77", "12345", "", S.WOULD_CREATE, S.REASON_NEW, "")
    df = spark.createDataFrame([row], ", ".join(f"{c} string" for c in ("report_id", *S.PARENT_COLUMNS)))
    held = lambda characters: [r.job_number for r in N.asked_pieces(df, [4, 5], characters).collect()]
    assert sorted(held([*"12345"])) == ["1234", "12345", "2345"]
    assert sorted(held([*"A-7"])) == ["A-77"]
    assert len(held(None)) == 21 + 20


def test_later_jobs_of_new_characters_are_found(spark, place):
    folder, run, _ = place
    drop(folder / "drop", "a.tsv", ("Campaign of A-77", "12345", "1"))
    run()
    drop(folder / "drop", "b.tsv", ("B", "2345", "1"), ("B", "A-77", "1"), ("B", "A-78", "1"), ("B", "paign", "1"))
    ledger = run()
    assert {k[1]: v for k, v in states(ledger).items() if k[0] == "b"} == {
        "2345": S.SKIP_EXISTS, "A-77": S.SKIP_EXISTS, "A-78": S.WOULD_CREATE, "paign": S.SKIP_EXISTS,
    }


def test_more_characters_than_an_index_is_cut_at(spark, place, monkeypatch):
    from bookwright.operators import existing as X

    monkeypatch.setattr(X, "MOST_CHARACTERS", 3)
    folder, run, _ = place
    drop(folder / "drop", "a.tsv", ("Camp", "12", "1"))
    ledger = run()
    drop(folder / "drop", "b.tsv", ("B", "am", "1"), ("B", "zz", "1"))
    run()
    drop(folder / "drop", "c.tsv", ("C", "mp", "1"), ("C", "Ca", "1"), ("C", "xy", "1"))
    run()
    assert {k[1]: v for k, v in states(ledger).items()} == {
        "12": S.WOULD_CREATE, "am": S.SKIP_EXISTS, "zz": S.WOULD_CREATE, "mp": S.SKIP_EXISTS, "Ca": S.SKIP_EXISTS, "xy": S.WOULD_CREATE,
    }
