import random
import re
from collections import Counter

import pytest
from conftest_llm import table

from fleetfault.llm import mixing
from pyspark.sql import functions as F


def water_level(sizes, weights=(5, 2, 1), epochs=3):
    """Shares by weight; what is above the cap is shared again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, target = set(), {}
    total = sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        rest = total - sum(epochs * sizes[s] for s in full)
        target = {s: epochs * sizes[s] if s in full else rest * weight[s] / sum(weight[o] for o in open_) for s in order}
        above = [s for s in open_ if target[s] > epochs * sizes[s] + 1e-9]
        if not above:
            return target
        full |= set(above)


def test_targets_equal_repeated_sharing(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 5, 50, 1000]) for s in ["a", "B", "é", "zz", "", None]}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        assert got == pytest.approx(water_level(sizes))


def test_draw_fills_targets(messy, messy_rows):
    drawn = mixing.draw(mixing.sized(messy), block_words=100, shard_blocks=4)
    got = drawn.collect()
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((x[0], x[3], size(x[1])) for x in messy_rows)
    taken = Counter()
    for r in got:
        words = sum(c["words"] for c in r.copies)
        assert words <= 3 * r["size"] and all(c["shard"] is not None for c in r.copies)
        taken[r.source] += words
    for r in got:
        assert abs(taken[r.source] - r.target) <= 0.5
    again = mixing.draw(mixing.sized(messy.repartition(7)), block_words=100, shard_blocks=4).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_tree_keeps_quotas_and_splits_evenly(spark):
    quotas = {0: 1000, 1: 37, 2: 0, 3: 5000}
    rows = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "source_no int, n long"), 7, 3).collect()
    totals, shards = Counter(), Counter()
    for r in rows:
        totals[r.source_no] += r.n
        shards[r.shard] += r.n
    assert totals == {k: v for k, v in quotas.items() if v}
    assert len(shards) == 128 and max(shards.values()) - min(shards.values()) <= 1
    # Source 3 has 39.06 blocks a shard; the hypergeometric law gives a variance near 6.5.
    part = [r.n for r in rows if r.source_no == 3]
    mean = sum(part) / 128
    assert 3 < sum((x - mean) ** 2 for x in part) / 128 < 12


def test_hypergeometric_draw(spark):
    draws = spark.range(4000).select(F.expr(mixing._draw("50L", "20L", "15L", "(id + 0.5D) / 4000")).alias("k")).groupBy("k").count()
    from math import comb

    for r in draws.collect():
        assert abs(r["count"] / 4000 - comb(20, r.k) * comb(30, 15 - r.k) / comb(50, 15)) < 1e-3


def test_mixed_documents_and_empty_table(messy, nothing):
    mixed = mixing.mixed_documents(messy)
    assert mixed.columns == messy.columns
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    drawn = {r.doc_id: r for r in mixing.draw(mixing.sized(messy)).collect() if r.doc_id not in (3, None)}
    for key, r in drawn.items():
        words = sum(c["words"] for c in r.copies)
        assert copies[key] == (int(words / r["size"] + 0.5) if r["size"] else 0)
    assert mixing.draw(mixing.sized(nothing)).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_one_id_in_two_sources(spark):
    """The copies of a row are its own, whatever other rows have its id."""
    rows = [(1, "w " * 50, None, "s", None), (1, "w " * 40, None, "t", None)]
    rows += [(k, "w " * 50, None, "t", None) for k in range(2, 200)]
    found = mixing.mixed_documents(table(spark, rows)).groupBy("doc_id", "source").count().collect()
    sizes = {(r.doc_id, r.source): r["count"] for r in found}
    drawn = mixing.draw(mixing.sized(table(spark, rows))).collect()
    for r in drawn:
        whole = sum(c.words for c in r.copies) / r.size
        assert abs(sizes.get((r.doc_id, r.source), 0) - whole) <= 0.5
    assert sizes[(1, "s")] == 3
