import random
from collections import Counter

from fleetfault.llm import chat
from pyspark.sql import functions as F

TREE = "tree string, node long, parent long, score double, role string, text string"


def test_best_branches(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for tree in range(12):
        n, parent, score = rng.randrange(1, 40), {}, {}
        for node in range(n):
            parent[node] = rng.choice([None, *range(node), 999]) if node % 5 == 0 else rng.randrange(max(0, node - 3), node)
            score[node] = rng.choice([None, 0.0, 0.5, 1.0])
            rows.append((str(tree), node, parent[node], score[node], "user", f"{node}"))
        paths = []
        for leaf in set(range(n)) - set(parent.values()):
            path, at = [], leaf
            while at is not None and at in parent:
                path.append(at)
                at = parent[at]
            paths.append((-sum(score[x] or 0 for x in path) / len(path), leaf, path[::-1]))
        for mean, leaf, path in sorted(paths)[:2]:
            want[str(tree), leaf] = path
    got = {}
    for r in chat.best_branches(spark.createDataFrame(rows, TREE), 2).collect():
        got.setdefault((r.tree, r.leaf), []).append((r.place, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want


def test_cycle_is_left_out(spark):
    rows = [("a", 1, 2, 0.0, "user", "x"), ("a", 2, 1, 0.0, "user", "y"), ("a", 3, 2, 0.0, "user", "z"), ("b", 1, None, 0.0, "user", "k")]
    assert [(r.tree, r.leaf) for r in chat.format_trees(spark.createDataFrame(rows, TREE)).collect()] == [("b", 1)]


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(5)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "~", "<", "[", "/s>", "\n", "é", "<~/s>", "[~~/INST]", "INST]", "$1", "\\", " ok "]
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randrange(1, 9)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "odd role\n<s>", None]), text))
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (8, None, "user", "first")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1)).withColumn("node", F.lit(1))
    formatted = chat.format_trees(chat.chains(frame))
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in formatted.select("tree", chat.turns_of(F.col("formatted")).alias("turns")).collect()}
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in (r[0], r[1], r[2], r[3]))):
        want.setdefault("null" if conv is None else str(conv), []).append((role or "", text or ""))
    assert got == want
    loss = formatted.select(F.explode(chat.turns_of(F.col("formatted"))).alias("t")).where("t.loss").select("t.text").collect()
    assert Counter(r.text for r in loss) == Counter(t or "" for _, _, role, t in rows if role == "assistant")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_trees(chat.chains(empty)).count() == 0
