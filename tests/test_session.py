"""The package reaches the executors without help from the environment."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import bookwright

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from bookwright.session import build_session
from bookwright.sources.reports import read_reports
spark = build_session("away", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {shared!r}}})
build_session("again", "local[2]")
print("ROWS", read_reports(spark, {file!r}).count())
"""


def test_files_are_read_from_another_folder(tmp_path):
    from bookwright import schema as S

    report = tmp_path / "r.tsv"
    report.write_text("\t".join(S.REQUIRED_COLUMNS) + "\n" + "\t".join('"a"' for _ in S.REQUIRED_COLUMNS) + "\n")
    script = SCRIPT.format(root=str(Path(bookwright.__file__).parents[1]), shared=str(tmp_path / "shared"), file=str(report))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]
