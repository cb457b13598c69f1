"""Generic helpers against brute force, with chunks small enough to cross borders."""

import random

import pytest
from pyspark.sql import functions as F

from fleetfault.operators import dedup, graph, matching, ordering, ranges


def _rows(seed, n=400):
    rng = random.Random(seed)
    out = []
    for key, share in (("hot", 0.7), ("a", 0.2), ("b", 0.1)):
        pos = 0
        for _ in range(int(n * share)):
            pos += rng.choice([1, 1, 1, 2, 9])
            out.append((key, pos, rng.choice("xyz"), rng.choice([None, 1, 2])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_scan_runs_previous(spark, chunk):
    rows = _rows(chunk)
    df = spark.createDataFrame(rows, "k string, o long, c string, v long").repartition(4)
    scanned = ordering.scan(df, ["k"], "o", last={"lv": F.col("v")}, total={"tv": F.col("v")}, chunk_rows=chunk)
    prev = ordering.previous(df, ["k"], "o", F.col("c"), "pc", chunk_rows=chunk)
    runs = ordering.mark_runs(df, ["k"], "o", ["c"], chunk_rows=chunk)
    got = {(r.k, r.o): (r.lv, r.tv) for r in scanned.collect()}
    got_prev = {(r.k, r.o): r.pc for r in prev.collect()}
    got_runs = {(r.k, r.o): r.run_start for r in runs.collect()}
    state = {}
    for k, o, c, v in sorted(rows):
        last, total, pc, start = state.get(k, (None, 0, None, None))
        last, total = (v if v is not None else last), total + (v or 0)
        start = o if c != pc else start
        assert got[(k, o)] == (last, total)
        assert got_prev[(k, o)] == pc
        assert got_runs[(k, o)] == start
        state[k] = (last, total, c, start)
    assert len(got) == len(rows)


def test_position_and_text(spark):
    rows = _rows(5)
    df = spark.createDataFrame(rows, "k string, o long, c string, v long").repartition(4)
    placed = ordering.with_position(df, ["k"], [F.col("c"), F.col("o").desc()]).collect()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in placed if r.k == key), key=lambda r: (r.c, -r.o))
        assert [r.pos for r in mine] == list(range(len(mine)))
    text = {r.k: r.t for r in ordering.ordered_text(df, ["k"], "o", "c", "t", "", chunk_rows=5).collect()}
    for key, value in text.items():
        assert value == "".join(r[2] for r in sorted(rows) if r[0] == key)


@pytest.mark.parametrize("seed", range(3))
def test_anchored_groups(spark, seed):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(600):
        t += rng.choice([0, 1, 3, 400, 900, -200]) if seed else rng.choice([1, 300])
        kind = "a" if seed == 0 or i < 350 else rng.choice("ab")
        rows.append(("hot", i, kind, None if seed == 2 and i % 97 == 0 else t))
    rows += [("cold", i, "a", i * 600) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, o long, c string, ms long").repartition(3)
    got = {(r.k, r.o): r.anchor for r in dedup.anchored_groups(df, ["k"], "o", ["c"], "ms", 1000).collect()}
    anchor = None
    for k, o, c, ms in sorted(rows, key=lambda r: (r[0], r[1])):
        same = anchor and anchor[0] == k and anchor[2] == c and None not in (ms, anchor[3])
        if not (same and abs(ms - anchor[3]) <= 1000):
            anchor = (k, o, c, ms)
        assert got[(k, o)] == anchor[1], (k, o)


def test_first_within(spark):
    rng = random.Random(3)
    values = [("h", i, rng.choice([5000, rng.randrange(20000)])) for i in range(500)]
    points = [("h", t) for t in [0, 5000, 5001, 7777, 19999]] + [("h", rng.randrange(20000)) for _ in range(20)]
    got = ranges.first_within(
        spark.createDataFrame(points, "k string, at long"),
        spark.createDataFrame(values, "k string, o long, t long"),
        ["k"], at="at", when="t", order="o", radius=2000, k=20,
    ).collect()
    found = {}
    for r in got:
        found.setdefault(r["at"], []).append(r.o)
    for _, at in points:
        want = [o for _, o, t in values if abs(t - at) <= 2000][:20]
        assert sorted(found.get(at, [])) == want


def test_containing_pairs(spark):
    texts = spark.createDataFrame([("r", "anr in com.app"), ("r", "pid 12 died"), ("q", "com.app")], "k string, t string")
    words = spark.createDataFrame([("r", "com.app"), ("r", "pid 1"), ("r", ""), ("r", "zz"), ("q", "app")], "k string, w string")
    got = {(r.k, r.t, r.w) for r in matching.containing_pairs(texts, words, ["k"], "t", "w").collect()}
    assert got == {("r", "anr in com.app", "com.app"), ("r", "pid 12 died", "pid 1"), ("q", "com.app", "app")}


@pytest.mark.parametrize("seed", range(2))
def test_graph(spark, seed):
    rng = random.Random(seed)
    links = {}
    for g in ("g1", "g2"):
        for v in range(40):
            if rng.random() < 0.8:
                links[(g, v)] = rng.randrange(45)
    rows = [(g, v, t) for (g, v), t in links.items()]
    edges = spark.createDataFrame(rows, "k string, node long, to long")
    order = spark.createDataFrame([(g, v, v) for g in ("g1", "g2") for v in range(45)], "k string, node long, rank long")
    cycles = graph.cycle_nodes(edges, ["k"])
    placed = {}
    for r in graph.cycle_order(edges.where("node <> to"), cycles, order, ["k"]).collect():
        placed.setdefault((r.k, r.cycle_id), {})[r.cycle_pos] = r.node
    want = {}
    for g in ("g1", "g2"):
        for v in range(45):
            path, at = [], v
            while at is not None and at not in path:
                path.append(at)
                at = links.get((g, at))
            if at is not None:
                ring = path[path.index(at):]
                if len(ring) > 1:
                    want.setdefault((g, min(ring)), ring)
    assert {k: [v[i] for i in range(len(v))] for k, v in placed.items()} == want
    starts = order.select("k", "node").where("node < 40")
    got = {}
    for r in graph.chains(edges, starts, cycles, ["k"]).collect():
        got.setdefault((r.k, r.start), {})[r.hop] = r.node
    for g in ("g1", "g2"):
        for v in range(40):
            seen, at, chain = set(), v, []
            while at not in seen:
                seen.add(at)
                at = links.get((g, at))
                if at is None:
                    break
                chain.append(at)
            mine = got.get((g, v), {})
            assert [mine[i] for i in sorted(mine)] == chain


def test_task_summary_is_bounded():
    import numpy as np

    for times in (np.arange(200_000) * 7, np.arange(200_000), np.arange(200_000)[::-1].copy()):
        lows, *_ = dedup._steps(times.astype(np.int64), np.arange(200_000), 1000)
        assert len(lows) <= 4 * 1000 + 3


@pytest.mark.parametrize("seed", range(40))
def test_sweep_equals_walk(seed):
    import numpy as np

    rng = random.Random(seed)
    n = rng.randrange(1, 60)
    sigs = np.array([rng.choice("aab") for _ in range(n)], object)
    ms = np.cumsum([rng.choice([0, 1, 5, -3, 20]) for _ in range(n)]).astype(np.int64)
    for i in range(n):
        if rng.random() < 0.05:
            ms[i] = dedup._NONE
    state = rng.choice([None, ("a", 3, -1), ("b", 3, -1), ("a", int(dedup._NONE), -1)])
    got, last = dedup._sweep(sigs, ms, np.arange(n), state, 10)
    for i in range(n):
        far = state is None or dedup._NONE in (ms[i], state[1]) or state[0] != sigs[i] or abs(int(ms[i]) - state[1]) > 10
        if far:
            state = (sigs[i], int(ms[i]), i)
        assert got[i] == state[2]
    assert last == state


@pytest.mark.parametrize("limit", [0, 6, 1 << 16])
def test_wait_graphs_in_tasks_and_by_doubling(spark, limit):
    """Graphs on either side of the limit give the same cycles and walks."""
    rng = random.Random(21)
    edges, order = [], []
    for k in range(12):
        n = rng.randrange(2, 14)
        ranks = rng.sample(range(100), n)
        for v in range(n):
            order.append((f"g{k}", v, ranks[v]))
            if rng.random() < 0.85:
                edges.append((f"g{k}", v, rng.randrange(n)))
    frame = lambda rows, last: spark.createDataFrame(rows, f"k string, node long, {last} long")
    e, o = frame(edges, "to"), frame(order, "rank")
    starts = o.where("rank % 3 = 0").select("k", "node")
    cycles = graph.cycle_nodes(e, ["k"])
    columns = ["k", "node", "cycle_id", "cycle_size", "cycle_pos", "cycle_rank"]
    want = graph.cycle_order(e.where("node <> to"), cycles, o, ["k"]).select(columns).collect()
    assert sorted(graph.ordered_cycles(e, o, ["k"], limit).select(columns).collect()) == sorted(want) and want
    want = graph.chains(e, starts, cycles, ["k"]).collect()
    assert sorted(graph.walks(e, starts, ["k"], limit).collect()) == sorted(want) and want
    assert graph.ordered_cycles(e.where("false"), o, ["k"], limit).count() == 0
