import random
import re

import pytest
from conftest_llm import table

from fleetfault.llm import jaccard
from fleetfault.llm.components import components


def shingles(text, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows, size, percent):
    sets = {k: shingles(t, size) for k, t in rows}
    lowest = {k: k for k in sets}

    def find(x):
        while lowest[x] != x:
            x = lowest[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                lowest[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_messy_table(messy, messy_rows, size, percent):
    rows = {r[0]: r[1] for r in messy_rows if r[0] is not None}
    want = brute(list(rows.items()), size, percent)
    got = jaccard.groups(messy, size, percent).collect()
    assert len(got) == len(messy_rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
        else:
            assert r.component_id is None


def test_many_near_copies_and_a_common_passage(spark, words):
    rng = random.Random(8)
    base = [rng.choice(words) for _ in range(60)]
    passage = [rng.choice(words) for _ in range(20)]
    rows = []
    for k in range(250):
        if k % 2:
            text = list(base)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(60)] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.randrange(5, 40))] + passage
        rows.append((k, " ".join(text), "en", "a", 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(table(spark, rows), 4, 85).collect()}
    assert got == brute([(r[0], r[1]) for r in rows], 4, 85)


def test_one_of_each(messy, messy_rows, nothing):
    kept = jaccard.one_of_each(messy)
    assert kept.columns == messy.columns
    rows = {r[0]: r[1] for r in messy_rows if r[0] is not None}
    want = {k for k, (_, lowest) in brute(list(rows.items()), 5, 80).items() if k == lowest}
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(x for x in ids if x is not None) == sorted(want) and ids.count(None) == 2
    assert jaccard.one_of_each(nothing).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(70)]
    lowest = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            lowest[a] = lowest[b] = min(lowest[a], lowest[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == lowest


@pytest.mark.parametrize("chunk", [50, 150])
def test_components_beyond_a_chunk(spark, monkeypatch, chunk):
    """More edges than a task may hold: forests and stars of many tasks give the same components."""
    import fleetfault.llm.components as module

    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(90)] + [(7, 7), (2000, 2000)]
    lowest = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            lowest[a] = lowest[b] = min(lowest[a], lowest[b])
    monkeypatch.setattr(module, "CHUNK", chunk)
    got = {r.node: r.component for r in module.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == lowest
    assert module.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id(spark, words):
    rng = random.Random(10)
    prose = lambda: " ".join(rng.choice(words) for _ in range(80))
    a, b = prose(), prose()
    rows = [(1, a, "en", "x", 1), (1, b, "en", "x", 1), (2, b + " more", "en", "x", 1), (3, a + " more", "en", "x", 1), (4, b, "en", "x", 1), (1, b, "en", "x", 1)]
    got = sorted((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in jaccard.groups(table(spark, rows)).collect())
    assert got == [(1, 76, 1, 1)] * 3 + [(2, 77, 2, 1), (3, 77, 3, 1), (4, 76, 1, 1)]
    kept = jaccard.one_of_each(table(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == sorted([(1, a), (1, b)])
