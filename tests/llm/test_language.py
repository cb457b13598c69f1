"""The gradient of the field beside sums over all labellings, and the operators away from the package."""

import itertools
import os
import subprocess
import sys

import numpy as np

from fleetfault.llm import language


def everything(scores, transitions, lengths):
    """Log of the sum over all labellings, word beliefs and pair counts, by enumeration."""
    k, total, at = scores.shape[1], 0.0, 0
    belief, pairs = np.zeros_like(scores), np.zeros_like(transitions)
    for n in lengths:
        weights = []
        ways = list(itertools.product(range(k), repeat=n))
        for way in ways:
            value = sum(scores[at + t, y] for t, y in enumerate(way)) + sum(transitions[a, b] for a, b in zip(way, way[1:]))
            weights.append(value)
        weights = np.array(weights)
        top = weights.max()
        share = np.exp(weights - top) / np.exp(weights - top).sum()
        total += top + np.log(np.exp(weights - top).sum())
        for way, p in zip(ways, share):
            for t, y in enumerate(way):
                belief[at + t, y] += p
            for a, b in zip(way, way[1:]):
                pairs[a, b] += p
        at += n
    return total, belief, pairs


def test_beliefs_of_words_and_pairs():
    rng = np.random.default_rng(1)
    for lengths in ([6], [1, 4, 2], [3, 3], [5, 1]):
        scores, moves = rng.normal(0, 2, (sum(lengths), 3)), rng.normal(0, 1, (3, 3))
        pairs = np.zeros((3, 3))
        belief = language.forward_backward(scores, np.array(lengths), moves, pairs)
        _, want, want_pairs = everything(scores, moves, lengths)
        assert np.allclose(belief, want) and np.allclose(pairs, want_pairs)


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(2)
    field = language.Field(["a", "b", "c"])
    field.transitions[:] = rng.normal(0, 1, (3, 3))
    size = rng.integers(1, 4, 7)
    edges = np.concatenate([[0], np.cumsum(size)])
    buckets = rng.integers(0, 9, edges[-1])
    field.weights[:9] = rng.normal(0, 1, (9, 3))
    words, lengths, label = np.arange(7), np.array([4, 3]), rng.integers(0, 3, 7)

    def likelihood():
        scores = np.array([field.weights[buckets[a:b]].astype(float).sum(0) for a, b in zip(edges, edges[1:])])
        known = sum(scores[t, label[t]] for t in range(7))
        known += sum(float(field.transitions[label[t], label[t + 1]]) for t in range(6) if t != 3)
        return known - everything(scores, field.transitions.astype(float), lengths)[0]

    touched, weights, moves = field.gradient(words, lengths, label, buckets, edges)
    for table, slope in ((field.weights, dict(zip(touched.tolist(), weights))), (field.transitions, dict(enumerate(moves)))):
        for row, values in slope.items():
            for j, value in enumerate(values):
                before = table[row, j]
                table[row, j] = before + 0.01
                up = likelihood()
                table[row, j] = before - 0.01
                down = likelihood()
                table[row, j] = before
                assert abs((up - down) / 0.02 - value) < 1e-3


def test_workers_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from fleetfault.session import local_session
from fleetfault.llm import queries
spark = local_session("2", 2)
for name in ("op2_lm_scores", "op11_piecewise_hashes", "op12_repair_conversations", "op13_whiten_embeddings"):
    print(name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300)
    assert "op13_whiten_embeddings 2000" in run.stdout, run.stderr[-2000:]
