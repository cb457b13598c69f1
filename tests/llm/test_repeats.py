import random
from collections import Counter

import pytest
from conftest_llm import table

from fleetfault.llm import repeats


def brute(rows, length):
    counts = Counter(text[p : p + length] for _, text in rows for p in range(len(text) - length + 1))
    out = []
    for key, text in rows:
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if counts[text[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for q in range(len(gone)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((key, len(text), sum(gone), runs, bytes(x for x, g in zip(text, gone) if not g)))
    return Counter(out)


def result(frame, *args):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(frame, *args).collect())


@pytest.mark.parametrize(("length", "kmer", "max_spans"), [(12, 5, 50_000), (20, 6, 50_000), (16, 4, 3)])
def test_random_texts(spark, length, kmer, max_spans):
    rng = random.Random(length)
    base = "".join(rng.choice("abc") for _ in range(300))
    rows = []
    for k in range(50):
        text = list(base[rng.randrange(200) :][: rng.randrange(150)]) if k % 2 else [rng.choice("ab") for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            if text:
                text[rng.randrange(len(text))] = rng.choice("abcdé")
        rows.append((k, "".join(text), None, None, None))
    rows += [(50, None, None, None, None), (51, "a" * 50, None, None, None), rows[1], (None, rows[1][1], None, None, None)]
    assert result(table(spark, rows), length, kmer, max_spans) == brute([(r[0], (r[1] or "").encode()) for r in rows], length)


def test_messy_table_and_pieces(messy, messy_rows, monkeypatch):
    want = brute([(r[0], (r[1] or "").encode()) for r in messy_rows], repeats.LENGTH)
    assert result(messy) == want


def test_text_in_pieces():
    import numpy as np
    import pyarrow as pa

    text = "".join(random.Random(3).choice("ab") for _ in range(5000))
    old, repeats.PIECE = repeats.PIECE, 300
    try:
        windows = set()
        for data, borders, row, shift in repeats._parts(pa.array([text]), 50):
            runs = repeats.Runs(data, borders, 50, 8)
            for a, b in zip(runs.first.tolist(), runs.last.tolist()):
                windows |= set(range(a + shift, b + shift + 1))
        assert windows == set(range(5000 - 50 + 1)) and row == 0
    finally:
        repeats.PIECE = old
    assert isinstance(runs.span, np.ndarray)


def test_groups_stream():
    """The groups of the first batches are worked on before the last batch is read."""
    import pyarrow as pa

    read = []

    def batches():
        for k in range(6):
            read.append(k)
            n = 15_000
            columns = [[k] * n, list(range(n)), [0] * n, [b"abcdefgh"] * n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["g", "span", "anchor", "content"]
            )

    got = repeats._sorted_groups(batches(), 4)
    first = next(got)
    assert first.num_rows and len(read) < 6
    assert first.num_rows + sum(x.num_rows for x in got) == 90_000


def test_empty_table(nothing):
    assert repeats.without_repeats(nothing).count() == 0
