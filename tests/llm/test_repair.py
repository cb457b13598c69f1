"""Repairs beside a plain search over all cheapest edits."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest_llm import table

from fleetfault.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = set(" \t\n\x0b\f\r")
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """(cost, audit, roles) of the best repair of [(initial, fault)], by the cost first and then the audit."""

    @functools.cache
    def best(i, state, inserts):
        """Least (cost, audit, roles) from row i on; the least of all ways, spelled out."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def way(price, letter, made, rest):
            if rest:
                ways.append((price + rest[0], letter + rest[1], made + rest[2]))

        other = "a" if state == "u" else "u"
        if inserts:
            way(5, "I", (("I", other),), best(i, other, inserts - 1))
        if i < len(rows):
            initial, fault = rows[i]
            way(2, "D", (), best(i + 1, state, 3))
            extra = 5 if fault == 3 else 0
            if fault in (0, 3):
                way(1 + extra, "R", ((i, other),), best(i + 1, other, 3))
                if (state, initial) in STEP:
                    way(extra, "K", ((i, None),), best(i + 1, initial, 3))
        return min(ways, key=lambda w: w[:2]) if ways else None

    return best(0, "", 3)


def plain(rows):
    """Summaries by conversation of undamaged [(conv, turn, role, text)]."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((((r[1] is not None), r[1] or 0, r[2], r[3]) for r in rows if r[0] == conv))
        seen, coded = set(), []
        for _, _, role, text in mine:
            bare = text.strip("".join(SPACE))
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            coded.append((role[:1], fault))
        cost, audit, roles = cheapest(coded)
        full = {"u": "user", "a": "assistant"}
        lines = [f"{full[new]}:" if i == "I" else f"{full[new] if new else mine[i][2]}:{mine[i][3]}" for i, new in roles]
        turns = {m[1] for m in mine if m[0]}
        pairs = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(coded, coded[1:]))
        counts = [sum(f == k for _, f in coded) for k in (1, 2, 3)]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        blank = lambda v: " " if v is None else v
        role, text = blank(role), blank(text)
        lot = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text = "" if lot == 1 else "".join(c for c in text if c not in ".!?") if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def some_rows(seed, conversations, longest):
    rng = random.Random(seed)
    words = ["Yes.", "No!", "Why?", "cut off", "", " \t", "one two. \n"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "", "tool", "unnamed"])
            text = rng.choice(words) if rng.random() < 0.5 else f"Text {turn}{rng.choice(['.', ''])}"
            rows.append((conv, rng.choice([turn, turn + 3, None]) if rng.random() < 0.2 else turn, role, text))
    return rows


@pytest.mark.parametrize("chunk_rows, fan", [(1024, 256), (3, 2), (1, 3)])
def test_repairs(spark, chunk_rows, fan):
    rows = [*some_rows(1, 60, 9), *[(None, k, "user", f"{k}.") for k in range(5)]]
    found = repair.summaries(table(spark, rows, SCHEMA), chunk_rows=chunk_rows, fan=fan).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == plain(rows)


def test_long_conversation_in_chunks(spark):
    rows = [(7, k, r, t) for k, (_, _, r, t) in enumerate(some_rows(2, 90, 9))] + some_rows(3, 3, 5)
    whole = repair.summaries(table(spark, rows, SCHEMA)).collect()
    cut = repair.summaries(table(spark, rows, SCHEMA), chunk_rows=5, fan=4).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut)) and len(whole) == 4
    turns = repair.repaired(table(spark, rows, SCHEMA), chunk_rows=5, fan=4).collect()
    for summary in whole:
        mine = sorted((t for t in turns if t.conv_id == summary.conv_id), key=lambda t: t.place)
        assert "".join(t.edit for t in mine) == summary.audit
        lines = [f"{t.new_role}:{t.text}" for t in mine if t.new_role is not None]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == summary.repaired_sha256
        initials = "".join(t.new_role[0] for t in mine if t.new_role is not None).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2)
        price = {"K": 0, "R": 1, "D": 2, "I": 5}
        assert summary.cost == sum(price[t.edit] + (5 if t.fault == "truncated" and t.edit in "KR" else 0) for t in mine)


def test_ranks_and_matrices():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randrange(0, 6) for _ in range(4)]
        rows = [[(rng.choice("sua?"), rng.randrange(4)) for _ in range(n)] for n in lengths]
        codes = np.array(["sua?".index(i) + 4 * f for r in rows for i, f in r], np.int64)
        ends = np.tile(np.array([0, 10, 5, 0]), (4, 1))
        costs, _, _, spell = repair.least_audits(codes, np.array(lengths), ends, np.ones(4, bool))
        want = [cheapest(r) for r in rows]
        assert [int(c) for c in costs[:, 0]] == [w[0] for w in want]
        assert spell(np.zeros(4, int)) == [w[1] for w in want]
        matrices = repair.chunk_matrices(codes, np.array(lengths))
        assert [(m[0] + ends[0]).min() for m in matrices] == [w[0] for w in want]


def test_odd_tables(spark):
    assert repair.summaries(table(spark, [], SCHEMA)).count() == 0
    rows = [(1, None, None, None), (1, None, "user", "x" * 200_000 + "."), (2, 5, "user", " ")] + [(3, 1, "user", "Same.")] * 40
    clean = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    found = repair.summaries(table(spark, rows, SCHEMA), chunk_rows=7, fan=2).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == plain(clean)
    ids = table(spark, [(9, 1, "user", "a"), (None, 1, "user", "a")], SCHEMA)
    left = repair.summaries(table(spark, [], SCHEMA), ids).collect()
    assert {r.conv_id for r in left} == {9, None}
    assert {tuple(r)[1:] for r in left} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(damaged(rows))
    found = {r.conv_id: tuple(r)[1:] for r in queries.op12_repair_conversations(spark, folder).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found == {conv: want.get(conv, empty) for conv in {r[0] for r in rows}}
