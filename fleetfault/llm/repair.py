"""Conversations repaired by the cheapest edits, and which of equally cheap ones, decided by rank.

The turns of a conversation must read ``(system? (user assistant)+)?``.  A row is kept (0), gets
another role (1) or is deleted (2, the only choice for blank and repeated rows); a turn without
text may be inserted anywhere (5); a truncated row that stays costs 5 more.  The audit of a repair
is the string of its edits' initials D, I, K, R; of the cheapest repairs the one whose audit comes
first is taken.

* Cost: a repair is a path through four states (empty, system, user, assistant) at every place
  between two rows.  Rows of a conversation are cut into chunks of ``CHUNK_ROWS``.  A chunk is a
  4 x 4 matrix of least costs; sums and minima of matrices are associative, so a tree of groups of
  ``FAN`` chunks tells each chunk what its end costs, and the DP then runs inside all chunks at once.
* Path: the arcs on cheapest paths remain.  Every node is ranked by the first letter of its least
  audit, then, pointer to pointer, by the first two, four, eight ...: the rank of twice the length is
  the rank of the pair (own rank, rank of the node that the pointer reaches).  Arcs out of one node
  differ in their letter, so its least arc, and with it the pointer, is unique; the doubled pointers
  then give any step of the least path at once.  Which state a chunk is entered in is a second scan
  of the tree, over the chunks' maps from entry to exit.
* A last pass reads each conversation's rows in order beside its audit and hands out the repaired
  turns.  Texts are shuffled once, for that pass; everything before works on their hashes.

Rows are ordered by turn (nulls first), role, the first 64 characters of the text and a hash of it.
A null role or text is one blank; a null conversation id is an id of its own; other columns are not
read.  An empty table gives no rows.  Two texts count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.operators.ordering import with_position
from fleetfault.session import scratch_folder

CHUNK_ROWS = 1024
FAN = 256
SPACE = " \t\n\x0b\f\r"
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
ROLES = ("user", "assistant")
FAULTS = ("", "blank", "duplicate", "truncated")

# States: nothing yet, system, user, assistant.  A turn of the other side follows; the end is at 0 or 3.
_NEXT = np.array([2, 2, 3, 2])
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by initial s, u, a, other
_FINAL = np.array([0, 10, 5, 0])
_NONE = 1 << 60

KEYS = ["conv", "nameless"]
_ORDER = ["turn", "role", "start", "h"]


def damage(df: DataFrame) -> DataFrame:
    """One row in twenty each dropped, emptied, robbed of its sentence ends, repeated, or made the user's,
    as ``crc32("conv_id:turn") % 20`` says."""
    or_blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = df.select(
        "conv_id", "turn", or_blank("role").alias("role"), or_blank("text").alias("text"),
        (F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20).alias("lot"),
    ).where("lot != 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("lot") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _rows(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(" "))
    return df.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("nameless"),
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.substring(text, 1, 64).alias("start"), F.xxhash64(text).alias("h"), text.alias("text"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("start"), F.col("h")]


def _chunks(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """``(conv, nameless, chunk, codes, turn, role, start, h)``: a byte for each row of a chunk (its initial, four times
    its fault), and the order of its first row."""
    bare = F.rtrim("text", F.lit(SPACE))
    light = rows.select(
        *KEYS, *_ORDER, (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("seen"),  # spreads equal rows over the ranges
    )
    light = with_position(light, KEYS, [*_order(), F.col("seen")])
    firsts = light.groupBy(*KEYS, "role", "h").agg(F.min("pos").alias("pos")).select(*KEYS, "pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + 4 * fault
    coded = light.join(firsts, [*KEYS, "pos"], "left").select(
        *KEYS, F.expr(f"pos div {chunk_rows}").alias("chunk"), "pos", F.chr(code + 48).alias("code"), *_ORDER
    )
    pairs = F.array_sort(F.collect_list(F.struct("pos", "code")))
    return (
        coded.groupBy(*KEYS, "chunk")
        .agg(F.array_join(F.transform(pairs, lambda p: p["code"]), "").alias("codes"), F.min_by(F.struct(*_ORDER), "pos").alias("key"))
        .select(*KEYS, "chunk", "codes", "key.*")
    )


def _back(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost from every place and state to each end of its chunk: ``(places, 4, ends)``, and the first place of each chunk."""
    first = np.cumsum(lengths + 1) - (lengths + 1)
    costs = np.empty((int((lengths + 1).sum()), 4, ends.shape[2]), np.int64)
    row_first = np.cumsum(lengths) - lengths

    def with_inserts(found: np.ndarray) -> np.ndarray:
        for _ in range(2):  # more than two in one place are never cheapest
            found = np.minimum(found, 5 + found[:, _NEXT])
        return found

    costs[first + lengths] = ends
    order = np.argsort(-lengths, kind="stable")
    for step in range(1, int(lengths.max(initial=0)) + 1):
        some = order[: int(np.searchsorted(-lengths[order], -step, "right"))]
        code = codes[row_first[some] + lengths[some] - step]
        after = costs[first[some] + lengths[some] - step + 1]
        found = 2 + after
        fault, initial = code >> 2, code & 3
        extra = np.where(fault == 3, 5, np.where(fault > 0, _NONE, 0))[:, None, None]
        found = np.minimum(found, 1 + extra + after[:, _NEXT])
        target = _KEPT[initial]
        kept = np.where((target >= 0)[:, :, None], np.take_along_axis(after, np.maximum(target, 0)[:, :, None], 1), _NONE)
        found = np.minimum(found, extra + kept)
        costs[first[some] + lengths[some] - step] = np.minimum(with_inserts(found), _NONE)
    return costs, first


def chunk_matrices(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Least cost of each chunk from entry to exit state, ``(chunks, 4, 4)``; turns inserted after its last row are not in it."""
    ends = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, _NONE), (len(lengths), 4, 4))
    costs, first = _back(codes, lengths, ends)
    return costs[first]


def least_audits(
    codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray, closing: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, object]:
    """Costs and exit states from all four entry states of each chunk, and a function that spells audits.

    ``ends``: what the states at the end of a chunk cost from there on; ``closing`` chunks end their
    conversation, and may insert after their last row.  Returns ``(costs, end costs, exits, spell)``.
    """
    costs, first = _back(codes, lengths, ends[:, :, None])
    costs = costs[:, :, 0]
    places, last = len(costs), first + lengths
    row_of = np.full(places, -1)
    inner = np.ones(places, bool)
    inner[last] = False
    row_of[inner] = np.arange(len(codes))
    code = np.where(inner, codes[np.maximum(row_of, 0)] if len(codes) else 0, 0)
    fault, initial = code >> 2, code & 3
    open_end = np.zeros(places, bool)
    open_end[last[closing]] = True
    extra = np.where(fault == 3, 5, np.where(fault > 0, _NONE, 0))
    place, states = np.arange(places)[:, None], np.arange(4)[None, :]
    after = costs[np.minimum(np.arange(places) + 1, places - 1)]
    target = _KEPT[initial]
    arcs = [  # letter by letter: (costs of the arc and what follows it, node it leads to)
        (np.where(inner[:, None], 2 + after, _NONE), 4 * (place + 1) + states),
        (np.where((inner | open_end)[:, None], 5 + costs[:, _NEXT], _NONE), 4 * place + _NEXT[None, :]),
        (np.where(inner[:, None] & (target >= 0), extra[:, None] + np.take_along_axis(after, np.maximum(target, 0), 1), _NONE),
         4 * (place + 1) + np.maximum(target, 0)),
        (np.where(inner[:, None], 1 + extra[:, None] + after[:, _NEXT], _NONE), 4 * (place + 1) + _NEXT[None, :]),
    ]
    nodes = np.arange(4 * places)
    letter, pointer = np.zeros(4 * places, np.int64), nodes.copy()  # 0: the chunk ends here
    for name in reversed(range(4)):
        optimal = (arcs[name][0] == costs).ravel()
        letter[optimal] = name + 1
        pointer[optimal] = np.broadcast_to(arcs[name][1], (places, 4)).ravel()[optimal]
    rank, length, doubled = letter.copy(), (letter > 0).astype(np.int64), [pointer]
    while (letter[pointer] > 0).any():
        _, rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)
        length = length + length[pointer]
        pointer = pointer[pointer]
        doubled.append(pointer)
    starts = 4 * first[:, None] + states

    def spell(entries: np.ndarray) -> list[str]:
        node = starts[np.arange(len(lengths)), entries]
        sizes = length[node]
        node, step = np.repeat(node, sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for k, jump in enumerate(doubled):
            node = np.where(step >> k & 1, jump[node], node)
        text = np.frombuffer(b" DIKR", np.uint8)[letter[node]].tobytes().decode("ascii")
        return [text[b - n : b] for b, n in zip(np.cumsum(sizes).tolist(), sizes.tolist())]

    ended = pointer[starts]
    return costs.ravel()[starts], costs.ravel()[ended], ended % 4, spell


def _ends(column: pa.Array) -> np.ndarray:
    return np.array([_FINAL if e is None else e for e in column.to_pylist()], np.int64).reshape(-1, 4)


def _minplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _NONE)


def _packs(batches: Iterator[pa.RecordBatch], limit: int = 1 << 14) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches of about ``limit`` codes, with their codes and lengths."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("codes")).to_pylist()
        lengths = np.array([len(t) for t in texts], np.int64)
        ends, low = np.cumsum(lengths), 0
        while low < len(texts):
            base = ends[low] - lengths[low]
            high = max(low + 1, int(np.searchsorted(ends, base + limit, "right")))
            codes = np.frombuffer("".join(texts[low:high]).encode("ascii"), np.uint8).astype(np.int64) - 48
            yield batch.slice(low, high - low), codes, lengths[low:high]
            low = high


_MATRICES = "conv long, nameless boolean, idx long, value array<long>"
_CARRIED = "conv long, nameless boolean, idx long, carried array<long>"


def _listed(rows: list[dict], name: str) -> pa.RecordBatch:
    kinds = [("conv", pa.int64()), ("nameless", pa.bool_()), ("idx", pa.int64()), (name, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _scanned(values: DataFrame, levels: int, start: list[int], backwards: bool, fan: int) -> DataFrame:
    """``(conv, nameless, idx, carried)``: ``start`` taken through the matrices of all chunks before (or, backwards, after) a chunk.

    ``values``: ``(conv, nameless, idx, value)`` with 4 x 4 matrices.  ``levels`` rounds of products of
    ``fan`` neighbours lead to one matrix a conversation, as many lead down again; each round is written.
    """
    spark = values.sparkSession
    folder = scratch_folder(spark)

    def kept(frame: DataFrame, name: str, form: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(form).parquet(f"{folder}/{name}")

    def grouped(frame: DataFrame, *more: Column) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("idx", "value")))
        return frame.groupBy(*KEYS, F.expr(f"idx div {fan}").alias("above"), *more).agg(parts.alias("parts"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                total = np.array(row["parts"][0]["value"]).reshape(4, 4)
                for part in row["parts"][1:]:
                    total = _minplus(total, np.array(part["value"]).reshape(4, 4))
                out.append({"conv": row["conv"], "nameless": row["nameless"], "idx": row["above"], "value": total.ravel().tolist()})
            yield _listed(out, "value")

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                carried = np.array(row["carried"])
                for part in reversed(row["parts"]) if backwards else row["parts"]:
                    out.append({"conv": row["conv"], "nameless": row["nameless"], "idx": part["idx"], "carried": carried.tolist()})
                    matrix = np.array(part["value"]).reshape(4, 4)
                    carried = np.minimum((matrix + carried[None, :]).min(axis=1) if backwards else (carried[:, None] + matrix).min(axis=0), _NONE)
            yield _listed(out, "carried")

    tiers = [kept(values, "up-0", _MATRICES)]
    for level in range(1, levels + 1):
        tiers.append(kept(grouped(tiers[-1]).mapInArrow(product, _MATRICES), f"up-{level}", _MATRICES))
    carried = tiers[-1].select(*KEYS, "idx", F.array(*[F.lit(s).cast("long") for s in start]).alias("carried"))
    for level in range(levels - 1, -1, -1):
        groups = grouped(tiers[level]).join(carried.withColumnRenamed("idx", "above"), [*KEYS, "above"])
        carried = kept(groups.mapInArrow(handed, _CARRIED), f"down-{level}", _CARRIED)
    return carried


def _audited(rows: DataFrame, chunk_rows: int, fan: int) -> DataFrame:
    """``(conv, nameless, chunk, codes, turn, role, start, h, audit, cost)`` for each chunk."""
    spark = rows.sparkSession
    folder = scratch_folder(spark)
    _chunks(rows, chunk_rows).write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    last = chunks.groupBy(*KEYS).agg(F.max("chunk").alias("last")).where("last > 0")
    longest = last.agg(F.max("last")).first()[0]
    fields = [*KEYS, "chunk", "codes", *_ORDER]
    alone = [F.lit(True).alias("closing"), F.lit(None).cast("array<long>").alias("ends"), F.lit(0).alias("entry")]
    if longest is None:  # no conversation has a second chunk
        staged = chunks.select(*fields, *alone)
    else:
        levels = 1
        while fan**levels <= longest:
            levels += 1
        long = chunks.join(last, KEYS).select(*fields, (F.col("chunk") == F.col("last")).alias("closing"))

        def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, codes, lengths in _packs(batches):
                found = chunk_matrices(codes, lengths).reshape(-1, 16).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=[*KEYS, "idx", "value"])

        values = long.select(*KEYS, "chunk", "codes").mapInArrow(matrices, _MATRICES)
        ends = _scanned(values, levels, _FINAL.tolist(), True, fan)
        long = long.join(ends.select(*KEYS, F.col("idx").alias("chunk"), F.col("carried").alias("ends")), [*KEYS, "chunk"])
        long.write.parquet(f"{folder}/long")
        long = spark.read.parquet(f"{folder}/long")

        def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, codes, lengths in _packs(batches):
                _, _, exits, _ = least_audits(codes, lengths, _ends(batch.column(5)), np.asarray(batch.column(4)))
                found = np.where(exits[:, :, None] == np.arange(4), 0, _NONE).reshape(-1, 16).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=[*KEYS, "idx", "value"])

        values = long.select(*KEYS, "chunk", "codes", "closing", "ends").mapInArrow(maps, _MATRICES)
        entries = _scanned(values, levels, [0, _NONE, _NONE, _NONE], False, fan)
        entry = F.array_position("carried", F.lit(0).cast("long")).cast("int") - 1
        long = long.join(entries.select(*KEYS, F.col("idx").alias("chunk"), entry.alias("entry")), [*KEYS, "chunk"])
        short = chunks.join(last, KEYS, "left_anti").select(*fields, *alone)
        staged = short.unionByName(long.select(*short.columns))

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, codes, lengths in _packs(batches):
            entry = np.asarray(batch.column(10))
            costs, left, _, spell = least_audits(codes, lengths, _ends(batch.column(9)), np.asarray(batch.column(8)))
            every = np.arange(len(lengths))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:8], pa.array(spell(entry), pa.string()), pa.array(costs[every, entry] - left[every, entry])],
                names=[*fields, "audit", "cost"])

    schema = "conv long, nameless boolean, chunk long, codes string, turn long, role string, start string, h long, audit string, cost long"
    return staged.mapInArrow(audits, schema)


class _Conversation:
    """One conversation, row by row: hands out ``(edit, fault, turn, role, new role, text)`` and keeps what its summary needs."""

    def __init__(self, conv: int | None):
        self.conv, self.pieces, self.at, self.code = conv, [], 0, 0
        self.state, self.place, self.cost, self.illegal, self.before = 0, 0, 0, 0, None
        self.faults, self.audit, self.hash, self.started = [0, 0, 0, 0], [], hashlib.sha256(), False
        self.turns = None  # (lowest, highest, number of different ones)

    def planned(self, audit: str, codes: str, cost: int) -> None:
        self.pieces.append((audit, codes))
        self.audit.append(audit)
        self.cost += cost

    def _letters(self) -> Iterator[str]:
        """Edits up to that of the next row, or up to the end."""
        while self.pieces:
            audit, codes = self.pieces[0]
            if self.at == len(audit):
                self.pieces.pop(0)
                self.at = self.code = 0
                continue
            self.at += 1
            yield audit[self.at - 1]

    def _said(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.started else "").encode() + role.encode() + b":" + text.encode())
        self.started = True

    def _inserted(self) -> tuple:
        self.state = int(_NEXT[self.state])
        role = ROLES[self.state - 2]
        self._said(role, "")
        return "I", "", None, None, role, ""

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if turn is not None:
            low, high, n = self.turns or (turn, turn, 0)
            self.turns = (low, turn, n + (n == 0 or turn != high))  # in rising order
        for letter in self._letters():
            if letter == "I":
                yield self._inserted()
                continue
            code = ord(self.pieces[0][1][self.code]) - 48
            self.code += 1
            initial, fault = code & 3, code >> 2
            self.faults[fault] += 1
            if self.before is not None:
                self.illegal += (self.before, initial) not in ((0, 1), (1, 2), (2, 1))
            self.before = initial
            new = role
            if letter == "D":
                new = None
            else:
                self.state = int(_NEXT[self.state] if letter == "R" else _KEPT[initial][self.state])
                new = ROLES[self.state - 2] if letter == "R" else role
                self._said(new, text)
            yield letter, FAULTS[fault], turn, role, new, text
            return
        raise ValueError(f"conversation {self.conv} has more rows than edits")

    def close(self) -> Iterator[tuple]:
        for _ in self._letters():
            yield self._inserted()

    def summary(self) -> dict:
        low, high, n = self.turns or (0, 0, 1)
        return {
            "conv_id": self.conv, "gaps": high - low + 1 - n, "blank": self.faults[1], "duplicate": self.faults[2],
            "truncated": self.faults[3], "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit),
            "repaired_sha256": self.hash.hexdigest(),
        }


TURNS = "conv_id long, place long, edit string, fault string, turn long, role string, new_role string, text string"
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def _told(df: DataFrame, ids: DataFrame, summaries: bool, chunk_rows: int, fan: int) -> DataFrame:
    rows = _rows(df)
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    edits = _audited(rows, chunk_rows, fan).select(
        *KEYS, *_ORDER, F.lit(1).alias("kind"), "chunk", nothing("string", "text"), "audit", "codes", "cost"
    )
    rows = rows.select(
        *KEYS, *_ORDER, F.lit(2).alias("kind"), F.lit(0).cast("long").alias("chunk"), "text",
        nothing("string", "audit"), nothing("string", "codes"), nothing("long", "cost"),
    )
    named = ids.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("nameless")).distinct()
    named = named.select(
        *KEYS, nothing("long", "turn"), nothing("string", "role"), nothing("string", "start"), nothing("long", "h"), F.lit(0).alias("kind"),
        F.lit(0).cast("long").alias("chunk"), nothing("string", "text"), nothing("string", "audit"), nothing("string", "codes"), nothing("long", "cost"),
    )
    order = [*KEYS, *_order(), "kind", "chunk"]
    stream = rows.unionByName(edits).unionByName(named).repartition(*KEYS).sortWithinPartitions(*order)
    schema = SUMMARY if summaries else TURNS
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (part.split() for part in schema.split(", "))])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Conversation | None = None

        def close() -> list[dict]:
            turns = list(held.close())
            return [held.summary()] if summaries else listed(turns)

        def listed(turns) -> list[dict]:
            out = []
            for turn in turns:
                out.append(dict(zip(names, (held.conv, held.place, *turn))))
                held.place += 1
            return out

        key = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["conv"], row["nameless"]) != key:
                    if held:
                        out += close()
                    key = (row["conv"], row["nameless"])
                    held = _Conversation(None if row["nameless"] else row["conv"])
                if row["kind"] == 1:
                    held.planned(row["audit"], row["codes"], row["cost"])
                elif row["kind"] == 2:
                    turns = held.row(row["turn"], row["role"], row["text"])
                    if summaries:
                        for _ in turns:
                            pass
                    else:
                        out += listed(turns)
            yield pa.RecordBatch.from_pylist(out, kinds)
        if held:
            yield pa.RecordBatch.from_pylist(close(), kinds)

    return stream.select(*KEYS, "kind", "turn", "role", "text", "audit", "codes", "cost").mapInArrow(told, schema)


def repaired(df: DataFrame, chunk_rows: int = CHUNK_ROWS, fan: int = FAN) -> DataFrame:
    """``TURNS``: every row and every inserted turn of each conversation in order, with its edit, its fault and the role it
    has afterwards (null: deleted)."""
    return _told(df, df, False, chunk_rows, fan)


def summaries(df: DataFrame, ids: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS, fan: int = FAN) -> DataFrame:
    """``SUMMARY`` of each conversation: gaps between its turns, faults, neighbours that may not stand together, cost and
    audit of its repair and the SHA-256 of the repaired ``role:text`` lines, which one task reads in order, row by row.

    Conversations of ``ids`` without rows have zeros, an empty audit and the hash of nothing.
    """
    return _told(df, df if ids is None else ids, True, chunk_rows, fan)
