"""Quality rules: statistics against the contract, estimates against numpy, verdicts on labelled documents."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bookwright.llm import outliers as O
from tests.llm.data import empty_documents, odd_documents, words


def stats(text: str) -> tuple:
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(own, own[1:], own[2:], strict=False))
    inside = {i + d for i, w in enumerate(zip(own, own[1:], own[2:], strict=False)) if windows[w] > 1 for d in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside)


_TEXT = st.lists(st.sampled_from(["a", "b", "b", "c", " ", "\n", " ", "#", "\x0b", "\x85", "　", "é", "|"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(_TEXT)
def test_statistics(text):
    got = dict(zip(O.STATS, O.text_stats(text), strict=True))
    assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == stats(text)
    assert got["n_upper"] == sum(c != c.lower() for c in text)


def test_chi_square():
    assert O.chi2_cdf(5.348, 6) == pytest.approx(0.5, abs=1e-3) and O.chi2_cdf(16.812, 6) == pytest.approx(0.99, abs=1e-4)


def test_estimate_of_bins_is_that_of_the_nearest_half(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(0, 3, (400, 6)) * O.SCALE).round().astype(int)
    v[:80] += 40 * O.SCALE
    df = spark.createDataFrame(pd.DataFrame(v, columns=[f"v{i}" for i in range(6)]).assign(grp="g")).repartition(5)
    best = O.estimates(df).first()
    center, inverse = np.array(best.center), np.array(best.inverse).reshape(6, 6)
    away = v / O.SCALE - center
    distance = np.einsum("ij,jk,ik->i", away, inverse, away)
    assert best.total == 400 and np.abs(center).max() < 1.5
    assert distance[:80].min() > 10 * np.quantile(distance[80:], 0.99)
    half = v[np.argsort(distance)[:203]] / O.SCALE
    assert np.abs(half.mean(axis=0) - center).max() < 0.4


def test_result_does_not_depend_on_the_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = (sorted(map(tuple, O.quality(d).collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == many


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = O.quality(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert all(r.kept == bool(r.quality) for r in rows) and len(rows) > 200


def test_groups(spark):
    rng = random.Random(4)
    usual = [(i, words(rng, 80) + ".\n" + words(rng, 60), "en", f"s{i % 2}") for i in range(120)]
    odd = [(200 + i, " ".join(w + "#$" for w in words(rng, 90).split()), "en", "rare") for i in range(2)]
    few = [(300, words(rng, 80), "xx", None), (301, words(rng, 3), None, "y")]
    df = spark.createDataFrame(usual + odd + few, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in O.quality(df).collect()}
    assert all(got[i].kept for i in range(120))
    # The two of a small source and the one of a small language find too few like them to be judged.
    assert got[200].kept and got[200].distance is None and got[300].kept and got[301].base_failed and not got[301].kept
    big = spark.createDataFrame([(i, t, "en", "s0") for i, t, *_ in usual + odd], df.schema)
    got = {r.doc_id: r.kept for r in O.quality(big).collect()}
    assert not got[200] and not got[201] and all(got[i] for i in range(120))


def test_each_statistic_rejects_on_its_own(spark):
    rng = random.Random(9)

    def text(n: int) -> list[str]:
        return words(rng, n).split()

    few, phrase, shared = text(40), text(23), text(14)
    planted = {
        "word_length": " ".join(w * 5 for w in text(90)),
        "symbols": " ".join(w + "#$" for w in text(90)),
        "dup_lines": "\n".join(rng.sample(few * 4, 160)),  # lines of a word, three in four of them repeated
        "repeats": " ".join([*phrase, *text(27), *phrase, *text(27)]),
        "upper": words(rng, 90).upper(),
        "marks": " ".join(w + "," for w in text(90)),
    }
    assert set(planted) == set(O.FLOORS)
    clean = "\n".join([*(" ".join(x) for x in (shared, shared)), " ".join(text(72))])  # a third and 0.28, as labelled clean texts have
    usual = [words(rng, 80) + ".\n" + words(rng, 60) for _ in range(150)] + [clean]
    rows = [(t, t, "en", "s") for t in [*usual, *planted.values()]]
    got = {r.doc_id: r for r in O.quality(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {name: got[t].kept for name, t in planted.items()} == dict.fromkeys(planted, False)
    assert all(got[t].kept for t in usual)
    other = got[planted["dup_lines"]]
    assert other.n_repeat_words < 0.1 * other.n_words and got[planted["repeats"]].n_dup_lines == 0


def test_odd_and_empty_documents(spark):
    odd = odd_documents(spark).selectExpr("*", "cast(null as string) lang", "'z' source", "1 v0", "'g' grp")
    rows = O.quality(odd).collect()
    assert len(rows) == odd.count() and all(r.base_failed and not r.kept for r in rows)
    assert O.quality(empty_documents(spark).selectExpr("*", "'' lang", "'' source")).count() == 0
