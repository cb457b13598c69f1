"""Language of texts by a linear-chain conditional random field over their words.

Each word gets a score for every language from its affixes, its character n-grams and its
place in the lexicons of the training words; learned transitions tie neighbouring words,
and forward-backward gives every word's probabilities in its context, so that a text in
several languages is labelled word by word.  A text's language is the one with the most
probable words.

Features are hashed into ``BUCKETS`` weights per language.  The model is fitted on the
driver from ``SAMPLE_TEXTS`` labelled texts and, of a language with less than ``SAMPLE_LEAST``
among them, so many of its own, each to at most ``SAMPLE_CHARS`` characters (the documented
bound of the sample), cut into runs of words that are strung together
across languages, so that the field sees switches.  Prediction runs in tasks, on whole
texts: a slice of a batch at a time, all its texts word by word in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.llm.words import scatter, slices, span_hashes, text_bytes, word_spans
from fleetfault.operators.ordering import top_rows

SAMPLE_TEXTS = 600
SAMPLE_LEAST = 24  # of each language that has them
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 16
AFFIXES = (1, 2, 3, 4)  # bytes at either end
GRAMS = (2, 3, 4)  # bytes anywhere
RUN_WORDS = (4, 24)  # shortest and longest run of one language in training
CHAIN_WORDS = 48
EPOCHS = 6
SLICE_BYTES = 8 << 20
NO_LANGUAGE = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
# Word edges carry no language: ASCII punctuation and digits are trimmed off.
_EDGE = np.zeros(256, bool)
_EDGE[[*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without punctuation and digits at their ends; a word of nothing else is empty."""
    if not len(starts):
        return starts, ends
    solid = np.flatnonzero(~_EDGE[data])
    if not len(solid):
        return starts, starts.copy()
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends) - 1
    filled = first <= last
    left = np.where(filled, solid[np.minimum(first, len(solid) - 1)], starts)
    right = np.where(filled, solid[np.maximum(last, 0)] + 1, starts)
    return left, right


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of each span, and the border of each span's buckets.

    Affixes of 1-4 bytes, n-grams of 2-4 bytes, and the word itself (its lexicon entry) by the
    hash in ``names``.
    """
    n = ends - starts
    folded = _FOLD[data]
    parts, owners = [], []

    def add(kind: int, at: np.ndarray, owner: np.ndarray, size: int) -> None:
        value = np.full(len(at), kind * 31 + size, np.uint64)
        for k in range(size):
            value = value * np.uint64(0x9E3779B97F4A7C15) + folded[at + k].astype(np.uint64) + np.uint64(1)
        parts.append((scatter(value) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner)

    rows = np.arange(len(starts))
    for size in AFFIXES:
        long = rows[n >= size]
        add(1, starts[long], long, size)
        add(2, ends[long] - size, long, size)
    for size in GRAMS:
        count = np.maximum(n - size + 1, 0)
        owner = np.repeat(rows, count)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        add(3, starts[owner] + inner, owner, size)
    filled = rows[n > 0]
    parts.append((names[filled] % np.uint64(BUCKETS)).astype(np.int32))
    owners.append(filled)
    owner, bucket = np.concatenate(owners), np.concatenate(parts)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(starts) + 1))


def emissions(weights: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Score of each language for each span; the sum of a span's feature weights, 0 for an empty one."""
    out = np.zeros((len(starts), weights.shape[1]), np.float32)
    for low in range(0, len(starts), 1 << 15):
        part = slice(low, low + (1 << 15))
        buckets, borders = word_features(data, starts[part], ends[part], names[part])
        sums = np.zeros((len(buckets) + 1, weights.shape[1]), np.float64)
        np.cumsum(weights[buckets], axis=0, out=sums[1:])
        out[part] = sums[borders[1:]] - sums[borders[:-1]]
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of the labels of every word; ``scores`` holds the chains one after another.

    The probabilities of the labels of all neighbours are added to ``pairs``, if there: forward message, move,
    emission and backward message of the second word.  Chains advance in step, longest first, so that step t works on one block of rows.
    """
    order = np.argsort(-lengths, kind="stable")
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
    offset = np.concatenate([[0], np.cumsum(alive)])
    begun = (np.cumsum(lengths) - lengths)[order]
    # Row of word t of the r-th longest chain, in the order of the steps.
    step = np.repeat(np.arange(len(alive)), alive)
    place = begun[np.arange(len(step)) - offset[step]] + step
    emit = scores[place]
    emit = np.exp(emit - emit.max(1, keepdims=True, initial=-1e30))
    move = np.exp(transitions - transitions.max()).astype(emit.dtype)
    ahead = np.empty_like(emit)
    for t, n in enumerate(alive):
        rows = slice(offset[t], offset[t] + n)
        value = emit[rows] if t == 0 else (ahead[offset[t - 1] : offset[t - 1] + n] @ move) * emit[rows]
        ahead[rows] = value / value.sum(1, keepdims=True)
    later = np.ones((0, scores.shape[1]), emit.dtype)
    for t in range(len(alive) - 1, -1, -1):
        n, rows = alive[t], slice(offset[t], offset[t] + alive[t])
        value = np.ones((n, scores.shape[1]), emit.dtype)
        value[: len(later)] = later @ move.T
        value /= value.sum(1, keepdims=True)
        later = value * emit[rows]
        if pairs is not None and t > 0:
            both = ahead[offset[t - 1] : offset[t - 1] + n, :, None] * move * later[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        found = ahead[rows] * value
        ahead[rows] = found / found.sum(1, keepdims=True)
    out = np.empty_like(ahead)
    out[place] = ahead
    return out


class Field:
    """Weights of the features and transitions; ``labels`` in ascending order."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((BUCKETS, len(labels)), np.float32)
        self.transitions = np.zeros((len(labels), len(labels)), np.float32)

    def fit(self, texts: list[str], langs: list[str], seed: int = 7) -> Field:
        """Stochastic gradient ascent of the conditional likelihood, with per-weight steps (AdaGrad)."""
        if len(self.labels) < 2:
            return self
        rng = np.random.default_rng(seed)
        data, borders = text_bytes(pa.array(texts, pa.string()))
        rows, starts, ends = word_spans(data, borders)
        starts, ends = _trimmed(data, starts, ends)
        label = np.array([self.labels.index(x) for x in langs])[rows]
        buckets, edges = word_features(data, starts, ends, span_hashes(data, starts, ends, True))
        change = np.flatnonzero(np.diff(rows)) + 1
        pieces = []
        for a, b in zip(np.concatenate([[0], change]), np.concatenate([change, [len(rows)]])):
            while a < b:
                size = int(rng.integers(*RUN_WORDS))
                pieces.append(np.arange(a, min(a + size, b)))
                a += size
        by_label: list[list[np.ndarray]] = [[] for _ in self.labels]
        for piece in pieces:
            if len(piece):
                by_label[label[piece[0]]].append(piece)
        share = max(map(len, by_label), default=0)
        weight_norm = np.full_like(self.weights, 1e-2)
        move_norm = np.full_like(self.transitions, 1e-2)
        for _ in range(EPOCHS):
            # Languages in equal parts, whatever their parts of the sample.
            runs = [p[k] for p in by_label if p for k in rng.integers(0, len(p), min(share, 2000))]
            rng.shuffle(runs)
            line = np.concatenate(runs) if runs else np.zeros(0, np.int64)
            for low in range(0, len(line), CHAIN_WORDS * 64):
                words = line[low : low + CHAIN_WORDS * 64]
                full = len(words) // CHAIN_WORDS
                lengths = np.array([CHAIN_WORDS] * full + ([len(words) % CHAIN_WORDS] if len(words) % CHAIN_WORDS else []))
                self._step(words, lengths, label, buckets, edges, weight_norm, move_norm)
        return self

    def gradient(self, words, lengths, label, buckets, edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log-likelihood of the labels of ``words`` in chains of ``lengths``: the buckets touched,
        the slope of their weights, and that of the transitions."""
        size = edges[words + 1] - edges[words]
        owner = np.repeat(np.arange(len(words)), size)
        own = buckets[np.repeat(edges[words] - (np.cumsum(size) - size), size) + np.arange(len(owner))]
        scores = np.zeros((len(words), len(self.labels)), np.float64)
        np.add.at(scores, owner, self.weights[own])
        expected = np.zeros(self.transitions.shape)
        belief = forward_backward(scores, lengths, self.transitions.astype(np.float64), expected)
        want = np.zeros_like(belief)
        want[np.arange(len(words)), label[words]] = 1
        touched, back = np.unique(own, return_inverse=True)
        total = np.zeros((len(touched), len(self.labels)))
        np.add.at(total, back, (want - belief)[owner])
        first = np.setdiff1d(np.arange(len(words) - 1), np.cumsum(lengths) - 1)
        seen = np.zeros(self.transitions.shape)
        np.add.at(seen, (label[words[first]], label[words[first + 1]]), 1)
        return touched, total, seen - expected

    def _step(self, words, lengths, label, buckets, edges, weight_norm, move_norm) -> None:
        touched, total, slope = self.gradient(words, lengths, label, buckets, edges)
        weight_norm[touched] += total**2
        self.weights[touched] += 0.2 * total / np.sqrt(weight_norm[touched])
        move_norm += slope**2
        self.transitions += (0.1 * slope / np.sqrt(move_norm)).astype(np.float32)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(label number or -1, score) of each text: the mean probability over words with a letter."""
        data, borders = text_bytes(column)
        n, k = len(borders) - 1, len(self.labels)
        best, score = np.full(n, -1), np.zeros(n)
        for low, high in slices(borders, SLICE_BYTES):
            part, edges = data[borders[low] : borders[high]], borders[low : high + 1] - borders[low]
            rows, starts, ends = word_spans(part, edges)
            starts, ends = _trimmed(part, starts, ends)
            names = span_hashes(part, starts, ends, True)
            names, at, back = np.unique(names, return_index=True, return_inverse=True)
            raw = part.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            lettered = np.fromiter((x.isalpha() or any(map(str.isalpha, x)) for x in texts), bool, len(texts))
            scores = emissions(self.weights, part, starts[at], ends[at], names)
            scores[~lettered] = 0
            lengths = np.bincount(rows, minlength=high - low)
            held = np.flatnonzero(lengths)
            belief = forward_backward(scores[back], lengths[held], self.transitions)
            counted = lettered[back]
            words = np.bincount(rows[counted], minlength=high - low)
            sums = np.stack([np.bincount(rows[counted], belief[counted, j], high - low) for j in range(k)], 1)
            some = np.flatnonzero(words)
            best[low:high][some] = sums[some].argmax(1)
            score[low:high][some] = np.minimum(sums[some].max(1) / words[some], 1)
        return best, score


def fit(training: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id") -> Field:
    """Fit on the bounded sample: the ``SAMPLE_TEXTS`` training rows with the lowest hash of their
    id, and the ``SAMPLE_LEAST`` lowest of each language, so that every language is learnt.

    Rows with a null text or language are not sampled.  A text above ``SAMPLE_CHARS`` is sampled,
    by its beginning, only where its language has too few others.
    Without any such row the field has no labels and every prediction is ``und``.
    """
    text, lang = F.col(text_column), F.col(lang_column)
    rows = training.where(text.isNotNull() & lang.isNotNull()).select(
        F.substring(text, 1, SAMPLE_CHARS).alias("text"), lang.alias("lang"), (F.length(text) > SAMPLE_CHARS).alias("long"),
        F.xxhash64(F.lit(7), id_column).alias("h"), F.xxhash64(text).alias("t"),
    )
    # The hashes first: the texts of each task's best would be many times the sample.
    names = rows.select("lang", "h", "t", "long")
    chosen = names.where(~F.col("long")).orderBy("h", "t").limit(SAMPLE_TEXTS).collect()
    chosen += top_rows(names.distinct(), ["lang"], [F.col("long"), F.col("h"), F.col("t")], SAMPLE_LEAST).select(names.columns).collect()
    found = training.sparkSession.createDataFrame([r[:3] for r in sorted(set(chosen))], names.select("lang", "h", "t").schema)
    sample = rows.join(F.broadcast(found), ["lang", "h", "t"], "left_semi").dropDuplicates(["lang", "h", "t"]).select("h", "text", "lang").collect()
    sample = sorted(sample, key=lambda r: (r.h, r.lang, r.text))
    return Field(sorted({r.lang for r in sample})).fit([r.text for r in sample], [r.lang for r in sample])


def held_out(id_column: Column) -> Column:
    """Rows that never train: a third of all, by the checksum of the id (a null id reads as empty)."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id_column, lang_pred, score)`` for each row of ``docs``, from its text alone.

    A text that is null or has no letter is ``und`` with score 0.  Null ids and repeated rows
    are kept as they are; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast((field.labels, field.weights, field.transitions))  # fixed size

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(model.value[0])
        _, own.weights, own.transitions = model.value
        for batch in batches:
            if own.labels:
                best, score = own.predict(batch.column(1))
            else:
                best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            names = pd.array([*own.labels, NO_LANGUAGE], dtype=object)[best]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return (
        docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        .mapInArrow(predicted, f"id {kind}, lang_pred string, score double")
        .withColumnRenamed("id", id_column)
    )
