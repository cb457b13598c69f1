"""Piecewise hashes beside a byte-by-byte version."""

import hashlib
import random

import numpy as np
import pytest
from conftest_llm import table
from pyspark.sql import functions as F

from fleetfault.llm import piecewise, queries
from fleetfault.llm.words import span_hashes


def one_hash(data, start, end):
    return int(span_hashes(np.frombuffer(data, np.uint8), np.array([start]), np.array([end]))[0])


def slow_pieces(data, level):
    """12-bit values of the pieces of one text at one level, runs cut to three."""
    ends = [e for e in range(1, len(data) + 1) if one_hash(data, max(0, e - 7), e) % (1 << level) == 0]
    if data and (not ends or ends[-1] != len(data)):
        ends.append(len(data))
    hashes = [one_hash(data, a, b) for a, b in zip([0, *ends], ends)]
    kept = [h for i, h in enumerate(hashes) if i < 3 or len(set(hashes[i - 3 : i + 1])) > 1]
    cuts = len(ends) - (1 if data and one_hash(data, max(0, len(data) - 7), len(data)) % (1 << level) else 0)
    return [h >> 52 for h in kept], cuts


def slow_print(text):
    data = text.encode()
    level = 2
    while slow_pieces(data, level)[1] >= 64:
        level += 1
    while level > 2 and len(slow_pieces(data, level)[0]) < 32 and len(slow_pieces(data, level - 1)[0]) <= 64:
        level -= 1
    return level, [slow_pieces(data, level + k)[0] for k in range(3)]


def slow_written(level, signatures):
    digits = piecewise.DIGITS.decode()
    return ":".join([str(2**level), *["".join(digits[v >> 6] + digits[v & 63] for v in s) for s in signatures]])


def slow_alike(a, b):
    common = max(a[0], b[0])
    if common - min(a[0], b[0]) > 2:
        return 0.0
    x, y = a[1][common - a[0]], b[1][common - b[0]]
    if not x and not y:
        return 1.0
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
    return 2 * best[-1][-1] / (len(x) + len(y))


def some_texts():
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdeiorsté") for _ in range(rng.randrange(1, 8))) for _ in range(n))
    texts = [prose(n) for n in (1, 2, 5, 20, 60, 250)]
    texts += [texts[-1][:500] + "edit" + texts[-1][500:], texts[-2] + texts[-3], "Unbroken" * 90, "a" * 300, "line of text\n" * 30, "", "é", "漢字😀"]
    return texts


def test_fingerprints_and_likeness():
    texts = some_texts()
    raw = [t.encode() for t in texts]
    found = piecewise.prints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    slow = [slow_print(t) for t in texts]
    text_form = piecewise.written(found)
    assert text_form == [slow_written(*s) for s in slow]
    back = piecewise.read_back(text_form)
    assert all((x == y).all() for x, y in zip(found, back))
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    a, b = (np.array(side) for side in zip(*pairs))
    assert np.allclose(piecewise.alike(found.at(a), found.at(b)), [slow_alike(slow[i], slow[j]) for i, j in pairs])


def test_slices_do_not_change_results(monkeypatch):
    data = np.frombuffer(" ".join(some_texts()).encode(), np.uint8)
    borders = np.array([0, len(data)])
    whole = piecewise.prints(data, borders)
    monkeypatch.setattr(piecewise, "SLICE", 100)
    assert all((x == y).all() for x, y in zip(whole, piecewise.prints(data, borders)))


def expected(rows):
    """Rows in falling id order, null ids last, ties as the hash of their text has them: only rows without ties are looked up."""
    out = {}
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    for k, (key, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mine = slow_print(text)
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), slow_written(*mine), slow_written(*slow_print(edited)),
                    slow_alike(mine, slow_print(edited)), slow_alike(mine, slow_print(after)))
    return out


def check(found, rows):
    want = expected(rows)
    assert len(found) == len(want)
    for r in found:
        assert tuple(r[1:5]) == want[r.doc_id][:4]
        assert np.allclose((r.near_edited, r.near_next), want[r.doc_id][4:])


@pytest.mark.parametrize("parts", ["1", "7"])
def test_next_text(spark, parts):
    rows = [(7 * k, t) for k, t in enumerate([*some_texts(), None])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        check(piecewise.compare_with_next(table(spark, rows, "doc_id long, text string")).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_messy_table(spark, messy, messy_rows, nothing):
    found = piecewise.compare_with_next(messy).collect()
    assert sorted(r.n_chars for r in found) == sorted(len(row[1] or "") for row in messy_rows)
    prints = {r[1] or "": None for r in messy_rows}
    by_size = {}
    for r in found:
        by_size.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len({next(iter(by_size[(k, len(messy_rows[3][1]))])) for k in (3,)}) == 1
    same = {row[1]: next(iter(by_size[(row[0], len(row[1]))])) for row in messy_rows if row[1] and row[0] is not None}
    assert len(set(same.values())) == len(same) <= len(prints)
    assert piecewise.compare_with_next(nothing).count() == 0
    lone = piecewise.compare_with_next(table(spark, [(5, "one two three four five six")], "doc_id long, text string")).first()
    assert lone.near_next == 1.0


def test_columns(spark, messy):
    pairs = messy.select(piecewise.fingerprint(F.col("text")).alias("f")).select(piecewise.likeness(F.col("f"), F.col("f")).alias("x"))
    assert {r.x for r in pairs.collect()} == {1.0}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 2500").select("doc_id", "text").collect()]
    short = {key for key, _ in rows}
    every = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op11_piecewise_hashes(spark, folder).collect()
    assert len(found) == len(every)
    ids = sorted((k for k, _ in every), reverse=True)
    texts = dict(every)
    for r in found:
        after = texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = r.n_chars // 2
        edited = texts[r.doc_id][: r.n_chars - half] + after[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    some = sorted(short)[:3]
    assert {r.doc_id: r.fingerprint for r in found if r.doc_id in some} == {k: slow_written(*slow_print(texts[k])) for k in some}
