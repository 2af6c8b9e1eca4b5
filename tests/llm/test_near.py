"""Near duplicates and components."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from bookwright.llm import components as C
from bookwright.llm import dart_minhash as D
from tests.llm.data import empty_documents, odd_documents, words


def grams(text: str) -> Counter:
    own = text.encode().split()
    return Counter(zip(*(own[i:] for i in range(5)), strict=False)) if len(own) >= 5 else Counter([tuple(own)] if own else [])


def similar(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def class_ids(rows: list[tuple]) -> dict:
    """By comparing all pairs that share a shingle."""
    g = [grams(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    holders: dict = {}
    for i, own in enumerate(g):
        for shingle in own or [None]:
            holders.setdefault(shingle, []).append(i)
    for ids in holders.values():
        for i in ids:
            for j in ids:
                if i < j and (g[i] == g[j] or similar(g[i], g[j]) >= 0.8):
                    root[find(i)] = find(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: least[find(i)] for i, (doc_id, _) in enumerate(rows)}


def test_signatures_estimate_weighted_similarity():
    elements = D.mix(np.arange(1, 201, dtype=np.uint64))
    one = np.linspace(0.1, 3, 200)
    two = one[::-1].copy()
    s = D.sketch(np.concatenate([elements, elements]), np.concatenate([one, two]), np.repeat([0, 1], 200), 2, 4000)
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.03
    assert (s != 0).all()


def test_a_signature_does_not_depend_on_its_neighbours():
    rng = random.Random(2)
    texts = [words(rng, n) for n in (1, 4, 5, 6, 50, 3000)] + ["", "a a a a a a a a a a"]
    whole = D.bands(texts)
    for i, text in enumerate(texts):
        assert (D.bands([text])[0] == whole[i]).all()
    assert D.weights(texts).tolist() == [sum(grams(t).values()) for t in texts]


def test_copies_of_all_kinds(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 120)) for i in range(40)]
    for base in range(8):  # a hot group of many near copies, and smaller ones
        for k in range(30 if base == 0 else 2):
            own = rows[base][1].split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "changed"
            rows.append((100 + base * 50 + k, "  ".join(own) + "\n"))
    passage = words(rng, 90)  # shared by texts that are no near duplicates
    rows += [(1000 + i, passage + " " + words(rng, 40)) for i in range(25)]
    rows += [(2000, ""), (2001, None), (2002, " \n"), (2003, "short one"), (2004, "short  one"), (2005, "other")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = D.near_classes(df).collect()
    assert {r.doc_id: r.class_id for r in got} == class_ids(rows) and len(got) == len(rows)
    sizes = Counter(r.class_id for r in got)
    assert all(r.n_docs == sizes[r.class_id] for r in got)
    kept = D.first_of_class(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(sizes)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = odd_documents(spark)
    got = D.near_classes(df).collect()
    assert len(got) == df.count()
    by_id = {r.doc_id: r.class_id for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == 0 and by_id[None] is None
    kept = D.first_of_class(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect())[None] == 1
    assert D.near_classes(empty_documents(spark)).count() == 0


def test_later_links_are_merged_from_root_to_root(spark):
    rng = random.Random(6)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    roots = C.components(spark.createDataFrame(links[:150], "a long, b long"))
    roots = C.merged(roots, spark.createDataFrame(links[150:], "a long, b long"))
    whole = C.components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, roots.collect())) == sorted(map(tuple, whole.collect()))


def test_each_round_goes_through_its_own_links_only(spark, monkeypatch):
    given, components = [], C.components
    monkeypatch.setattr(C, "components", lambda links: given.append(links.count()) or components(links))
    # 20 chains of 12 in one bucket each: a comparison with the first lead links two, later ones the others.
    members = spark.createDataFrame([(c, 100 * c + i, 1) for c in range(20) for i in range(12)], "bucket long, id long, size int")
    links, roots = C.linked_classes(members, lambda pairs: pairs.filter("b = a + 1"))
    assert links.count() == 20 * 11 and len(given) > 2
    assert sum(given) == links.count()
    assert {(r.id, r.root) for r in roots.collect()} == {(100 * c + i, 100 * c) for c in range(20) for i in range(12)}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (95, 100), (7, 7), (None, 3), (200, 200)]
    got = {r.id: r.root for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90, 200: 200}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_link_in_a_bucket_is_lost(spark):
    rng = random.Random(8)
    true = {(a, b) for a in range(60) for b in range(a) if rng.random() < 0.03}
    members = spark.createDataFrame([(k, i, 1) for k in range(2) for i in range(60) if (i + k) % 3], "bucket long, id long, size int")
    table = spark.createDataFrame([(min(p), max(p)) for p in true], "a long, b long")
    _, roots = C.linked_classes(members, lambda pairs: pairs.join(table, ["a", "b"], "left_semi"))
    root = {i: i for i in range(60)}
    for _ in range(60):
        for a, b in true:
            if any((a + k) % 3 and (b + k) % 3 for k in range(2)):
                root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in roots.collect()}
    assert {i: got.get(i, i) for i in range(60)} == root


def test_rare_buckets_keep_all_links(spark):
    """Every pair at 0.8 or more meets, whatever the sizes; texts around one passage don't."""
    rng = random.Random(6)
    sets = []
    for _ in range(25):
        base = set(rng.sample(range(100_000), rng.choice([1, 2, 3, 5, 9, 30, 120, 300])))
        sets.append(base)
        for _ in range(5):
            own = set(base)
            for _ in range(rng.randint(0, max(1, len(base) // 7))):
                own.discard(rng.choice(sorted(own)))
                if rng.random() < 0.6:
                    own.add(rng.randrange(100_000))
            sets.append(own or {1})
    passage = set(range(200_000, 200_170))
    first = len(sets)
    sets += [passage | set(range(300_000 + 100 * i, 300_000 + 100 * i + 30)) for i in range(60)]  # 0.74 among each other
    own = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, cells array<int>")
    buckets: dict = {}
    for r in D._rare_buckets(own, own.select("id")).collect():
        buckets.setdefault(r.bucket, set()).add((r.id, r.side))
    met = {(a, b) for ids in buckets.values() for a, s in ids for b, t in ids if a < b and (s != t or s == C.BOTH)}
    true = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(true) > 100 and true <= met
    assert not any(a >= first for a, _ in met)


def test_passages_and_near_copies_together(spark):
    """Texts that meet in bands through a passage, with near copies among them, against all pairs."""
    rng = random.Random(9)
    passage = words(rng, 150)
    rows = []
    for i in range(40):
        own = words(rng, rng.randint(15, 30))
        rows.append((i, passage + " " + own))
        if i % 4 == 0:
            rows.append((100 + i, passage + " " + own + " " + words(rng, 3)))
        if i % 10 == 0:
            rows += [(1000 + 10 * i + k, words(rng, 2) + " " + passage + " " + own) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in D.near_classes(df).collect()} == class_ids(rows)
