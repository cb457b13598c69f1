"""Token counts of whole texts by a compiled finite-state transducer.

A byte-pair tokenizer keeps this property: of all tokens that may end a prefix of the
text, exactly one is its last token, and it is the one that stands unmerged beside the
last token of what comes before it.  So reading left to right needs only a bounded
memory: for each position at which a token may still be open, the last token before it
and how many tokens it had.  Each such memory is a state of a deterministic transducer;
a transition on a character is annotated with the tokens it emits (negative where a
longer token replaces several).  States are made when first met and kept by the worker.

A text is cut where every state leads to the start state: before the blank that follows
other text, and on both sides of a line end.  A chunk's state map is therefore constant
and its count does not depend on its neighbours; the maps compose by a prefix sum over
the chunks, and a text's count is the difference of two of its values.  Equal chunks
are run once for each slice of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfault.llm.words import slices, span_hashes, text_bytes, worker_store

BLANK = "▁"
MAX_TOKENS = 4096
SLICE_BYTES = 4 << 20  # texts counted at once; equal chunks among them are run once
KEPT_CHUNKS = 1 << 20  # counts a worker remembers before it starts anew; no influence on results
KEPT_STATES = 1 << 18


class Transducer:
    """Deterministic transducer of a sentencepiece byte-pair model, compiled as it is used.

    ``step[state]`` maps a character to ``(next state, emitted tokens)``.  State 0 is the
    start: nothing before this point can join what comes.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = [i for i in range(library.get_piece_size())
                   if library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)]
        pieces = {library.id_to_piece(i): i for i in range(library.get_piece_size())}
        for i in special:
            pieces.pop(library.id_to_piece(i))
        self.score = {piece: library.get_score(i) for piece, i in pieces.items()}
        if any(BLANK in piece.lstrip(BLANK) for piece in self.score):
            raise ValueError("pieces with an inner blank: chunks would depend on each other")
        self.open = {piece[:k] for piece in self.score for k in range(len(piece))}
        self.cuts_at_newline = not any("\n" in piece for piece in self.score)
        self.fallback = library.is_byte(library.piece_to_id("<0x00>"))
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.start()

    def start(self) -> None:
        self.ids = {(("", None, 0),): 0}
        self.members = [(("", None, 0),)]
        self.step: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """The tokens of a short string: best-scored neighbours join first, leftmost on ties."""
        parts = list(text)
        while True:
            best = max(
                ((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score),
                default=None,
            )
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def stands(self, before: str | None, token: str) -> bool:
        """Whether ``token`` stays a token of its own after ``before``."""
        key = (before, token)
        if key not in self.pairs:
            self.pairs[key] = self.merged((before or "") + token) == ([before, token] if before else [token])
        return self.pairs[key]

    def compile(self, state: int, char: str) -> tuple[int, int]:
        if char not in self.score:  # falls back to its bytes, or to one unknown token
            found = (0, len(char.encode()) if self.fallback else 1)
            self.step[state][char] = found
            return found
        grown, last = [], None
        for begun, before, count in self.members[state]:
            text = begun + char
            if last is None and text in self.score and self.stands(None, text) and self.stands(before, text):
                last = (text, count + 1)
            if text in self.open:
                grown.append((text, before, count))
        token, emitted = last
        members = (*((text, before, count - emitted) for text, before, count in grown), ("", token, 0))
        target = self.ids.setdefault(members, len(self.members))
        if target == len(self.members):
            self.members.append(members)
            self.step.append({})
        self.step[state][char] = (target, emitted)
        return target, emitted

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """Exit state and emitted tokens of a chunk, for one entry state."""
        step, total = self.step, 0
        for char in text:
            state, emitted = step[state].get(char) or self.compile(state, char)
            total += emitted
        return state, total

    def count(self, chunk: str) -> int:
        if len(self.members) > KEPT_STATES:
            self.start()
        return self.run(chunk.replace(" ", BLANK))[1]


def _chunks(data: np.ndarray, borders: np.ndarray, newline: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the chunks of the texts, and which of them open a text."""
    blank = data == 0x20
    solid = ~blank  # what a blank may start a chunk after: anything but a blank, however written
    solid[2:] &= ~((data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2))
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = blank[1:] & solid[:-1]
    if newline:
        line = data == 0x0A
        cut[:-1] |= line
        cut[1:] |= line
    opens = borders[:-1][borders[1:] > borders[:-1]]
    cut[opens] = True
    starts = np.flatnonzero(cut[:-1])
    return starts, np.isin(starts, opens)


def count_batch(transducer: Transducer, known: dict, column: pa.Array) -> np.ndarray:
    """Tokens of each text of a column."""
    data, borders = text_bytes(column)
    out = np.zeros(len(borders) - 1, np.int64)
    for low, high in slices(borders, SLICE_BYTES):
        part, edges = data[borders[low] : borders[high]], borders[low : high + 1] - borders[low]
        starts, opens = _chunks(part, edges, transducer.cuts_at_newline)
        if not len(starts):
            continue
        ends = np.append(starts[1:], len(part))
        names = span_hashes(part, starts, ends) + opens.astype(np.uint64)
        unique, at, back = np.unique(names, return_index=True, return_inverse=True)
        raw, counts = part.tobytes(), np.zeros(len(unique), np.int64)
        if len(known) > KEPT_CHUNKS:
            known.clear()
        for k, (name, first) in enumerate(zip(unique.tolist(), at.tolist())):
            n = known.get(name)
            if n is None:
                chunk = raw[starts[first] : ends[first]].decode("utf-8", "replace")
                n = known[name] = transducer.count(" " + chunk if opens[first] else chunk)
            counts[k] = n
        scanned = np.concatenate([[0], np.cumsum(counts[back])])  # constant maps compose by adding
        border = np.searchsorted(starts, edges)
        out[low:high] = scanned[border[1:]] - scanned[border[:-1]]
    return out


def token_counts(
    docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text", limit: int = MAX_TOKENS
) -> DataFrame:
    """``(id_column, n_bytes, n_tokens, over_limit)``, one row for each row of ``docs``.

    Counts equal those of the sentencepiece library without begin and end tokens.  A null
    or empty text has 0 bytes and 0 tokens; null ids and repeated rows are kept as they
    are; other columns are not read.  ``model_file`` must exist on every worker.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store(f"transducer {model_file}")
        for batch in batches:
            if "machine" not in store:
                store["machine"], store["known"] = Transducer(model_file), {}
            n = count_batch(store["machine"], store["known"], batch.column(1))
            size = np.diff(text_bytes(batch.column(1))[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return (
        docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        .mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
        .withColumnRenamed("id", id_column)
    )
