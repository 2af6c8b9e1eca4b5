"""Chains of response pages against a walk from page to page."""

from __future__ import annotations

import json
import random

from bookwright.sources import tasks as K


def walk(pages: dict) -> tuple[str, int, str]:
    """Status, pages reached and the missing offset of one project; ``pages`` are next offsets by own offset."""
    if "" not in pages:
        return K.NO_FIRST_PAGE, 0, ""
    seen, at = set(), ""
    while at in pages and at not in seen:
        seen.add(at)
        at = pages[at]
        if not at:
            return K.COMPLETE, len(seen), ""
    return (K.CYCLE, len(seen), "") if at in seen else (K.MISSING_PAGE, len(seen), at)


def test_chains_equal_the_walk(spark, tmp_path):
    rng = random.Random(7)
    want, lines = {}, []
    for project in range(60):
        n = rng.choice([1, 2, 3, 9, 40])
        offsets = ["", *(f"o{i}" for i in range(1, n))]
        pages = dict(zip(offsets, [*offsets[1:], ""]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            pages[rng.choice(offsets)] = rng.choice([*offsets, "gone"])  # a cycle, a cut, a lost page
        if rng.random() < 0.3:
            del pages[rng.choice(list(pages))]
        if not pages:
            continue
        want[str(project)] = (*walk(pages), len(pages))
        for own, following in pages.items():
            page = {"data": [{"name": f"n{own}"}, "stray"], "project_gid": str(project)}
            page |= {"offset": own} if own else rng.choice([{}, {"offset": None}, {"offset": ""}])
            page |= {"next_page": {"offset": following}} if following else rng.choice([{}, {"next_page": None}, {"next_page": {}}, {"next_page": "x"}])
            lines += [json.dumps(page)] * rng.choice([1, 1, 2])
    (tmp_path / "pages.json").write_text("\n".join(lines))
    chained = K.chain_pages(K.read_pages(spark, str(tmp_path)))
    got = {r.project_gid: (r.status, r.reached, r.missing, r.pages) for r in K.page_chain_status(chained).collect()}
    assert got == want
    names = K.task_names(chained.filter("reached")).groupBy("project_gid").count()
    assert {r.project_gid: r["count"] for r in names.collect()} == {k: v[1] for k, v in want.items() if v[1]}


def test_no_pages(spark):
    empty = spark.createDataFrame([], "project_gid string, data array<string>, offset string, next_page string")
    assert K.page_chain_status(K.chain_pages(empty)).collect() == []
