"""Token-id shards as wavelet matrices: one compressed file per shard.

A shard holds the ids of whole texts in ascending order of their document id.  Its ids
are stored as bit-planes, highest bit first; each plane orders the ids stably by the
bits above it.  A directory of ranks every 2**16 bits makes rank and select local, so one
file answers ``ids[i]``, the count of an id in any range, and the place of its k-th
occurrence, reading one block per plane.  Blocks are compressed singly.

Files are the binary rows of a table written by Spark, so any file system that Spark
writes can hold them and a lost task leaves no half file behind.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetfault.llm.words import resting, slices, span_hashes, text_bytes, word_spans, worker_store
from fleetfault.session import scratch_folder

END_ID = 2
SHARD_IDS = 1 << 21  # a shard ends with the text that reaches so many ids
BLOCK = 1 << 16  # bits of a plane between two entries of the rank directory
SLICE_BYTES = 4 << 20  # texts between two looks at whether the shard is full
CODED_BYTES = 2 << 20  # texts encoded at once; equal spans among them are looked up once
KEPT_SPANS = 1 << 20  # spans a worker remembers before it starts anew; no influence on results
MAGIC = b"FWM1"
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")  # letters that no normal form changes, one capital to one small letter


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def write_file(ids: np.ndarray, keys: np.ndarray, missing: np.ndarray, lengths: np.ndarray) -> bytes:
    """A shard: its ids, and key (``missing``: null) and number of ids of each text, in order."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    kind = np.uint16 if bits <= 16 else np.uint32
    level, parts, sizes, zeros, ranks = ids.astype(kind), [], [], [], []
    for plane in range(bits - 1, -1, -1):
        bit = (level & kind(1 << plane)).astype(bool)
        bytewise = np.packbits(bit, bitorder="little")
        full = np.bitwise_count(bytewise[: len(bit) // BLOCK * (BLOCK // 8)]).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(full)]).astype(np.uint32)
        packed = bytewise.tobytes()
        blocks = [packed[k : k + BLOCK // 8] for k in range(0, len(packed), BLOCK // 8)]
        stored = [min(b, zlib.compress(b, 1), key=len) for b in blocks] if _worth_packing(blocks) else blocks
        parts += stored
        sizes.append([len(b) for b in stored])
        ranks.append(before)
        low = level.compress(~bit)
        zeros.append(len(low))
        level = np.concatenate([low, level.compress(bit)])
    side = [_packed(x) for x in (keys.astype(np.int64), missing.astype(np.uint8), lengths.astype(np.int64),
                                 np.array(zeros, np.int64), np.array(sizes, np.uint32), np.array(ranks, np.uint32))]
    head = struct.pack("<4sQQB6I", MAGIC, len(ids), len(keys), bits, *map(len, side))
    return b"".join([head, *side, *parts])


def _worth_packing(blocks: list[bytes]) -> bool:
    return bool(blocks) and len(zlib.compress(blocks[len(blocks) // 2], 1)) < 0.9 * len(blocks[len(blocks) // 2])


class Shard:
    """A shard file opened: random access reads single blocks, ``ids()`` reads all."""

    def __init__(self, raw: bytes):
        magic, self.n, texts, self.bits, *sizes = struct.unpack_from("<4sQQB6I", raw)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at, side = struct.calcsize("<4sQQB6I"), []
        for size, kind in zip(sizes, (np.int64, np.uint8, np.int64, np.int64, np.uint32, np.uint32)):
            side.append(np.frombuffer(zlib.decompress(raw[at : at + size]), kind))
            at += size
        self.keys, missing, self.lengths, self.zeros = side[:4]
        self.missing = missing.astype(bool)
        self.sizes, self.ranks = side[4].reshape(self.bits, -1), side[5].reshape(self.bits, -1)
        ends = at + np.cumsum(self.sizes.ravel(), dtype=np.int64).reshape(self.sizes.shape)
        self.starts, self.raw = ends - self.sizes, raw

    def block(self, plane: int, k: int) -> np.ndarray:
        """The bits of one block."""
        start, size = int(self.starts[plane, k]), int(self.sizes[plane, k])
        length = min(BLOCK, self.n - k * BLOCK)
        stored = self.raw[start : start + size]
        if size != (length + 7) // 8:
            stored = zlib.decompress(stored)
        return np.unpackbits(np.frombuffer(stored, np.uint8), count=length, bitorder="little")

    def rank(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        k = i // BLOCK
        return int(self.ranks[plane, k]) + (int(self.block(plane, k)[: i % BLOCK].sum()) if i % BLOCK else 0)

    def select(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of this value."""
        ones = self.ranks[plane].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        at = int(np.searchsorted(before, k, "right")) - 1
        return at * BLOCK + int(np.flatnonzero(self.block(plane, at) == bit)[k - before[at]])

    def __getitem__(self, i: int) -> int:
        value = 0
        for plane in range(self.bits):
            bit = int(self.block(plane, i // BLOCK)[i % BLOCK])
            ones = self.rank(plane, i)
            i = int(self.zeros[plane]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        for plane in range(self.bits):
            a, b = self.rank(plane, start), self.rank(plane, stop)
            if value >> (self.bits - 1 - plane) & 1:
                start, stop = int(self.zeros[plane]) + a, int(self.zeros[plane]) + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id in a range."""
        if value >> self.bits:
            return 0
        start, stop = self._range(value, start, self.n if stop is None else stop)
        return stop - start

    def find(self, value: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of an id."""
        start, stop = self._range(value, 0, self.n) if value >> self.bits == 0 else (0, 0)
        if not 0 <= k < stop - start:
            raise IndexError(k)
        i = start + k
        for plane in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - plane) & 1
            i = self.select(plane, bit, i - int(self.zeros[plane]) * bit)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order: planes are undone from the lowest up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        level = np.zeros(self.n, kind)
        for plane in range(self.bits - 1, -1, -1):
            blocks = [self.block(plane, k) for k in range(self.sizes.shape[1])]
            bit = (np.concatenate(blocks) if blocks else np.zeros(0, np.uint8)).astype(bool)
            above, low = np.empty_like(level), int(self.zeros[plane])
            above[np.flatnonzero(~bit)] = level[:low]
            above[np.flatnonzero(bit)] = level[low:] | kind(1 << (self.bits - 1 - plane))
            level = above
        return level


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(len(array), size - len(array)), array.dtype)])


class SpanEncoder:
    """Ids of texts by a ``tokenizers`` file, each distinct span encoded once per worker.

    A tokenizer that drops blanks and never joins across them is fed words, without regard
    to the case of A-Z where it folds case, cut once more between a letter and the ASCII
    mark after it.  Any other tokenizer is fed whole texts.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        setup = json.loads(self.tokenizer.to_str())
        split = json.dumps(setup.get("pre_tokenizer"))
        self.by_word = '"invert": true' in split and '"behavior": "Removed"' in split and "[^\\\\s\\\\p{L}\\\\p{N}]+" in split
        self.folds = self.by_word and '"Lowercase"' in json.dumps(setup.get("normalizer"))
        special = [x for x in setup.get("added_tokens", []) if x["special"] and "|" in x["content"] and x["content"] == x["content"].strip()]
        self.mark = (special[0]["content"], special[0]["id"]) if special else None
        # Not cut before an apostrophe, which may begin a contraction, nor within a string that is matched before words are.
        inside = "'" + "".join(x["content"] for x in setup.get("added_tokens", []))
        self.marks = np.zeros(256, bool)
        self.marks[[k for k in range(0x21, 0x7F) if not chr(k).isalnum() and chr(k) not in inside]] = True
        self.plain = self._plain(setup) if self.folds else None
        self.clear()

    def _plain(self, setup: dict):
        """The same model fed small letters and blanks alone, without the steps that leave them as they are; None
        where that is not known.  The last id of a word is one of those that end words."""
        from tokenizers import Tokenizer, pre_tokenizers

        model, added = setup["model"], [x["content"] for x in setup.get("added_tokens", [])]
        known = (
            [(x["type"], x.get("pattern")) for x in setup["normalizer"].get("normalizers", [])]
            == [("NFC", None), ("Replace", {"Regex": "\\s+"}), ("Lowercase", None)]
            and [x["type"] for x in setup["pre_tokenizer"].get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout")
            and not any(PLAIN.fullmatch(x) for x in added)
        )
        if not known:
            return None
        split, level = setup["pre_tokenizer"]["pretokenizers"]
        first, _, _ = split["pattern"].get("Regex", "").partition("[\\p{L}]+")
        if level["add_prefix_space"] or level["use_regex"] or not re.fullmatch("('[a-z]+\\|)*", first):
            return None
        ends = [k for word, k in model["vocab"].items() if word.endswith(model["end_of_word_suffix"])]
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[ends] = True
        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        return plain

    def clear(self) -> None:
        self.names, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # known spans, in order of their names
        self.fresh: list[np.ndarray] = []
        self.count = 0
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def learn(self, names: np.ndarray, texts: list[str]) -> None:
        """Encode new spans.  Many go in one call, held apart by blanks if they are letters alone, or else by a
        special token that they cannot contain (no bar), since calls cost more than short words."""
        mark = self.mark if self.by_word else None
        rest = range(len(texts))
        if self.plain:
            words = [bool(PLAIN.fullmatch(x)) for x in texts]
            letters, rest = np.flatnonzero(words), np.flatnonzero(~np.array(words, bool)).tolist()
            for low in range(0, len(letters), 4096):
                part = letters[low : low + 4096]
                joined = " ".join([texts[k] for k in part]).lower()
                ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                at = np.flatnonzero(self.ends[ids])
                if len(at) == len(part):
                    self.keep(names[part], ids, np.diff(at, prepend=-1))
                else:  # a letter that the model lacks
                    rest += part.tolist()
        whole = [k for k in rest if mark is None or "|" in texts[k]]
        for low in range(0, len(whole), 1024):
            part = whole[low : low + 1024]
            coded = [x.ids for x in self.tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)]
            self.keep(names[part], sum(coded, []), list(map(len, coded)))
        apart = set(whole)
        short = [k for k in rest if k not in apart]
        for low in range(0, len(short), 4096):
            part = short[low : low + 4096]
            joined = mark[0].join([texts[k] for k in part])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == mark[1])
            sizes = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
            self.keep(names[part], np.delete(ids, at), sizes)
        both = np.concatenate([self.names, *self.fresh])
        order = np.argsort(both)
        self.names = both[order]
        self.entry = np.concatenate([self.entry, np.arange(len(self.entry), len(both))])[order]
        self.fresh = []

    def keep(self, names: np.ndarray, ids, sizes) -> None:
        """Append the ids of spans to the pool, which grows by doubling."""
        first, sizes = self.count, np.asarray(sizes, np.int64)
        self.pool = _grown(self.pool, self.used + len(ids))
        self.start, self.length = _grown(self.start, first + len(names)), _grown(self.length, first + len(names))
        self.pool[self.used : self.used + len(ids)] = ids
        self.length[first : first + len(names)] = sizes
        self.start[first : first + len(names)] = self.used + np.cumsum(sizes) - sizes
        self.fresh.append(names)
        self.count += len(names)
        self.used += len(ids)

    def spans(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.by_word:
            rows = np.flatnonzero(borders[1:] > borders[:-1])
            return rows, borders[:-1][rows], borders[1:][rows]
        rows, starts, ends = word_spans(data, borders)
        cut = np.flatnonzero(self.marks[data[1:]]) + 1
        last, lead = data[cut - 1], data[np.maximum(cut - 2, 0)]
        beyond = (lead == 0xC3) & (last >> 6 == 2) & (last != 0x97) & (last != 0xB7)  # À to ÿ
        cut = cut[((last | 0x20) - np.uint8(97) < 26) | beyond]
        owner = np.searchsorted(starts, cut, "right") - 1
        inner = (owner >= 0) & (cut > starts[owner]) & (cut < ends[owner])  # a text may end between the two
        cut, owner = cut[inner], owner[inner]
        order = np.argsort(np.concatenate([starts, cut]), kind="stable")
        return (np.concatenate([rows, rows[owner]])[order], np.concatenate([starts, cut])[order],
                np.sort(np.concatenate([ends, cut])))

    def encode(self, data: np.ndarray, borders: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and the number of ids of each."""
        n = len(borders) - 1
        rows, starts, ends = self.spans(data, borders)
        names = span_hashes(data, starts, ends, self.folds)
        if self.folds:  # special strings are matched before case is folded, and hold a bar
            barred = np.unique(np.searchsorted(starts, np.flatnonzero(data == 0x7C), "right") - 1)
            names[barred] = ~span_hashes(data, starts[barred], ends[barred])
        order = np.argsort(names)
        ordered = names[order]
        first = np.ones(len(names), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        unique, at = ordered[first], order[first]
        if len(self.names) > KEPT_SPANS:
            self.clear()
        place = np.searchsorted(self.names, unique)
        new = np.ones(len(unique), bool)
        inner = place < len(self.names)
        new[inner] = self.names[place[inner]] != unique[inner]
        if new.any():
            raw = data.tobytes()
            self.learn(unique[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            place = np.searchsorted(self.names, unique)
        entry = np.empty(len(names), np.int64)
        entry[order] = self.entry[place][np.cumsum(first) - 1]
        length = self.length[entry]
        stop = np.cumsum(length)
        total = int(stop[-1]) if len(stop) else 0
        sizes = np.bincount(rows, weights=length, minlength=n).astype(np.int64) + 1
        last = np.cumsum(sizes) - 1
        inside = np.ones(total + n, bool)
        inside[last] = False
        source = np.repeat(self.start[entry] - (stop - length), length)
        source += np.arange(total)
        out = np.empty(total + n, np.uint32)
        out[np.flatnonzero(inside)] = self.pool[source]
        out[last] = end_id
        return out, sizes


def write_shards(
    docs: DataFrame,
    tokenizer_file: str,
    path: str | None = None,
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Write the ids of all texts as shard files and return the table of files:
    ``(part, shard, n_ids, n_texts, file)``; ``(part, shard)`` ascends with the key.

    A null text is empty and has only the end id; null keys come first; repeated rows are
    all written; other columns are not read.  ``path`` defaults to a new place in the
    checkpoint folder.  A task holds one shard, which is ``shard_ids`` ids and the rest of
    the text that crosses them.
    """

    def flush(shard: int, ids: list, keys: list, missing: list, sizes: list) -> pa.RecordBatch:
        joined = [np.concatenate(x) for x in (ids, keys, missing, sizes)]
        file = write_file(*joined)
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()),
            "n_ids": pa.array([len(joined[0])], pa.int64()), "n_texts": pa.array([len(joined[1])], pa.int64()),
            "file": pa.array([file], pa.binary()),
        })

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store(f"span encoder {tokenizer_file}")
        shard, held, kept = 0, 0, ([], [], [], [])
        for batch in batches:
            if "encoder" not in store:
                store["encoder"] = SpanEncoder(tokenizer_file)
            key = batch.column(0)
            absent = np.asarray(key.is_null())
            key = np.asarray(key.fill_null(0))
            data, borders = text_bytes(batch.column(1))
            for low, high in slices(borders, min(SLICE_BYTES, 2 * shard_ids)):
                edges = borders[low : high + 1]
                for a, b in slices(edges, CODED_BYTES):
                    ids, sizes = store["encoder"].encode(data[edges[a] : edges[b]], edges[a : b + 1] - edges[a], end_id)
                    for piece, value in zip(kept, (ids, key[low + a : low + b], absent[low + a : low + b], sizes)):
                        piece.append(value)
                    held += len(ids)
                if held >= shard_ids:
                    yield flush(shard, *kept)
                    shard, held, kept = shard + 1, 0, ([], [], [], [])
        if kept[0]:
            yield flush(shard, *kept)

    spark = docs.sparkSession
    path = path or scratch_folder(spark)
    (
        docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text"))
        .repartitionByRange(F.col("key").asc_nulls_first())
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
        .mapInArrow(lambda batches: resting(coded(batches)), "part int, shard int, n_ids long, n_texts long, file binary")
        .write.parquet(path)
    )
    return read_shards(spark, path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, shard int, n_ids long, n_texts long, file binary").parquet(path)


def text_digests(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, part, shard)`` of each text, read back from the files.

    ``start`` counts the ids of all texts before it.  Sums per part and then over parts
    (one row for each task that wrote) give it, so nothing is scanned in one task.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"])
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.keys, mask=shard.missing), pa.array(starts), pa.array(shard.lengths), pa.array(sums, pa.int64()),
                     pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["shard"], np.int32))],
                    names=["doc_id", "inside", "n_tokens", "ids_crc32", "part", "shard"])

    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("part_start"))
    shards = (
        files.select("part", "shard", F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("shard")), F.lit(0)).alias("s"))
        .join(parts, "part")
        .select("part", "shard", (F.col("part_start") + F.col("s")).alias("shard_start"))
    )
    texts = files.select("part", "shard", "file").mapInArrow(
        lambda batches: resting(opened(batches)), "doc_id long, inside long, n_tokens long, ids_crc32 long, part int, shard int"
    )
    return texts.join(shards, ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "part", "shard"
    )
