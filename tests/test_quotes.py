"""The quote scan against a machine that reads one character at a time, and the state of a file's pieces."""

from __future__ import annotations

import csv
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from bookwright.sources import reports as P
from bookwright.sources.lines import PIECE_SCHEMA, _Quotes, _Walk, describe_pieces


def machine(line: str, inside: bool, sep: str) -> tuple[bool, bool]:
    """Whether the line ends inside quotes, and whether text follows a closing quote."""
    state, stray, i = ("quoted" if inside else "start"), False, 0
    while i < len(line):
        c = line[i]
        if state == "start":
            state = "quoted" if c == '"' else "start" if c == sep else "plain"
        elif state == "plain":
            state = "start" if c == sep else "plain"
        elif state == "quoted":
            if c == '"' and line[i + 1 : i + 2] == '"':
                i += 1
            elif c == '"':
                state = "behind"
        elif c == sep:
            state = "start"
        else:
            state, stray = "plain", True
        i += 1
    return state == "quoted", stray


@pytest.mark.parametrize("sep", [",", "\t"])
def test_scan_equals_the_machine(sep):
    rng = random.Random(3)
    for _ in range(3000):
        weights = rng.choice([(5, 3, 4), (1, 4, 6), (8, 4, 1)])
        lines = ["".join(rng.choices(['"', sep, "a"], weights, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 12))]
        quotes = _Quotes(pa.array([x.encode() for x in lines], pa.binary()), sep)
        for opened in (False, True):
            walk = _Walk(open=opened)
            numbers = walk.step(quotes)
            state, record, stray, want = opened, 0, False, []
            for line in lines:
                record += not state
                want.append(record)
                state, odd = machine(line, state, sep)
                stray |= odd
            assert (list(numbers), walk.open, walk.stray) == (want, state, stray), lines
        cells = quotes.fields()
        for line, n in zip(lines, cells):
            if not machine(line, False, sep)[0]:
                assert n == len(next(csv.reader([line], delimiter=sep), [""])) or not line, line


def test_only_odd_lines_go_through_patterns(monkeypatch):
    lines = [b'"a","b, c","d ""e"" f"', b"plain,cells", b'"x","","y"'] * 2000 + [b'5" pipe,x']
    quotes = _Quotes(pa.array(lines, pa.binary()), ",")
    assert len(quotes.events[0]) == 1 and (quotes.fields()[:3] == [3, 2, 3]).all()


def seconds(lines: list[bytes]) -> float:
    n = len(lines)
    batch = pa.RecordBatch.from_arrays([pa.array(["f.csv"] * n), pa.array([0] * n), pa.array(lines, pa.binary())], ["p", "b", "v"])
    best = 9.0
    for _ in range(3):
        start = time.perf_counter()
        list(describe_pieces(iter([batch]), 0))
        best = min(best, time.perf_counter() - start)
    return best


def test_quoted_files_are_read_about_as_fast():
    plain = [b"some campaign,12345,ref 9,a property name,a place,a text,01/02/2025"] * 40_000
    quoted = [b",".join(b'"' + c + b'"' for c in line.split(b",")) for line in plain]
    assert seconds(quoted) < 6 * seconds(plain)  # 3 on a quiet machine


def test_pieces_of_large_files(spark):
    """The state and the record number that each piece begins with, against a fold in plain Python."""
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for name, n in (("a", 3000), ("b", 1), ("c", 700)):
        state, records = False, 0
        for block in range(n):
            ends = rng.choice([0, 1, 2, 3], p=[0.7, 0.2, 0.05, 0.05])
            closed, opened = [(False, True), (True, False), (False, False), (True, True)][ends]
            rc, ro = (int(x) for x in rng.integers(0, 50, 2))
            stray = [bool(x) for x in rng.integers(0, 2, 2)]
            rows.append((name, block * 100, True, False, False, closed, opened, rc, ro, *stray, None, None, 0, 0))
            want[name, block * 100] = (state, records, stray[state])
            records += ro if state else rc
            state = opened if state else closed
            want[name, "end"] = state
    pieces = spark.createDataFrame(rows, PIECE_SCHEMA).repartition(8)
    got = P._placed(pieces).collect()
    assert {(r.file_path, r.block): (r.begins_open, r.records_before, r.stray) for r in got} == {k: v for k, v in want.items() if k[1] != "end"}
    last = {name: max((r for r in got if r.file_path == name), key=lambda r: r.block).ends_open for name in "abc"}
    assert last == {name: want[name, "end"] for name in "abc"}
