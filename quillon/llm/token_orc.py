"""Token ids of documents as ORC files.

Documents lie in ascending id order over the files and within them. ORC writes ids in stripes
with integer run-length encoding, and row indexes and Bloom filters on doc_id: scans split
between stripes, and a lookup by id skips files, stripes and row groups from metadata alone.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.blobs import bounded
from quillon.llm.spool import parts_for
from quillon.llm.wordhash import text_bytes

END_ID = 1
STRIPE_BYTES, ROWS_PER_INDEX, BLOOM_FALSE_POSITIVES = 64 << 20, 10_000, 0.01
#: Distinct pieces whose ids a worker remembers at most, and bytes of text that it encodes at a time: workers are kept between stages, and so is this memory.
PIECES_KEPT, BLOCK_BYTES = 1 << 18, 1 << 20
#: Pieces up to this length are known by their bytes, packed into two integers; longer ones are encoded where they occur.
PACKED = 15
_loaded: dict = {}
U = np.uint64

#: Normalizer and pre-tokenizer (fixed values of the public word-level vocabulary) for which a text's ids are its pieces' ids in a row.
_BY_PIECES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

# Classes of bytes. Odd ones, apostrophes, control characters and all beyond ASCII, never part from a neighbour.
_WHITE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _WHITE
_CLASS[33:127] = _MARK
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[0x27] = _ODD
#: Does a piece, or a gap, begin at a byte of class c after one of class p: [8 * p + c].
_EDGE = np.zeros(64, bool)
for _p in range(5):
    for _c in range(5):
        _EDGE[8 * _p + _c] = (_p == _WHITE) != (_c == _WHITE) or (_p == _c == _DIGIT) or (_p != _c and _ODD not in (_p, _c))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], U)
#: Only a-z and letters of Latin-1: such a piece is one pre-token and needs no normalizer but lower-casing.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _slots(low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    h = (low ^ (high * U(0xD6E8FEB86659FD93))) * U(0x9E3779B97F4A7C15)
    return ((h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(64 - bits)).astype(np.int64)


class PieceTable:
    """Numbers pieces by their packed bytes: an open-addressed table whose every step handles a whole block."""

    def __init__(self, most: int):
        self.bits = max(4, (2 * most - 1).bit_length())
        self.most, self.n = most, 0
        self.low, self.high = np.zeros(most, U), np.zeros(most, U)
        self.at = np.full(1 << self.bits, -1, np.int32)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each piece's number, -1 if it has none."""
        slot = _slots(low, high, self.bits)
        found = self.at[slot]
        left = np.flatnonzero((found >= 0) & ((self.low[found] != low) | (self.high[found] != high)))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.at) - 1)
            now = self.at[slot]
            found[left] = now
            again = (now >= 0) & ((self.low[now] != low[left]) | (self.high[now] != high[left]))
            left, slot = left[again], slot[again]
        return found

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        """Number distinct pieces that have no number yet, in a row."""
        number = np.arange(self.n, self.n + len(low), dtype=np.int32)
        self.low[number], self.high[number] = low, high
        slot = _slots(low, high, self.bits)
        while len(number):
            free = self.at[slot] < 0
            self.at[slot[free]] = number[free]
            lost = self.at[slot] != number
            number, slot = number[lost], (slot[lost] + 1) & (len(self.at) - 1)
        self.n += len(low)


class WordEncoder:
    """Encodes by pieces: runs of ASCII letters, single digits and runs of ASCII marks are pre-tokens of
    their own, so a text is cut there and at white space, and each distinct piece is encoded once and remembered.
    A tokenizer that cuts texts otherwise than ``_BY_PIECES`` says encodes them whole."""

    def __init__(self, path: str, most: int = PIECES_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        given = json.loads(self.tokenizer.to_str())
        self.by_pieces = all(given[k] == v for k, v in _BY_PIECES.items()) and (given["model"].get("end_of_word_suffix") or "") != ""
        self.special = [t["content"].encode() for t in given["added_tokens"]]
        self.most = most
        if self.by_pieces:
            # plain pieces, already lower-case: the same model after a split at spaces alone
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix, vocabulary = given["model"]["end_of_word_suffix"], self.tokenizer.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._empty()

    def _empty(self) -> None:
        self.table = PieceTable(self.most)
        self.start, self.length, self.used = np.zeros(self.most, np.int64), np.zeros(self.most, np.int64), np.zeros(self.most, np.int64)
        self.pool, self.filled = np.zeros(1 << 20, np.int32), 0

    def _remember(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, z = self.table.n, self.table.n + len(low)
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.start[n:z], self.length[n:z], self.used[n:z] = self.filled + np.cumsum(lengths) - lengths, lengths, 0
        self.filled += len(ids)
        self.table.add(low, high)

    def _make_room(self, wanted: int, needed: np.ndarray) -> None:
        """Forget the pieces that were least used, but none of the needed ones, until the wanted room and, if it can be, half of all is free."""
        n, keep = self.table.n, max(len(needed), min(self.most // 2, self.most - wanted))
        rank = -self.used[:n]
        rank[needed] = np.iinfo(np.int64).min
        order = np.sort(np.argsort(rank, kind="stable")[:keep])
        low, high, used, lengths = self.table.low[order], self.table.high[order], self.used[order] // 2, self.length[order]
        ids = self._gather(order)
        self._empty()
        self._remember(low, high, ids, lengths)
        self.used[: len(used)] = used

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of numbered pieces in a row."""
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.start[numbers] - (ends - lengths), lengths) + np.arange(total)]

    def _ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct pieces, and how many each has."""
        plain = [i for i, p in enumerate(pieces) if _PLAIN.fullmatch(p)]
        runs: list[np.ndarray] = []
        lengths = np.zeros(len(pieces), np.int64)
        for low in range(0, len(plain), 1 << 14):
            some = plain[low : low + (1 << 14)]
            calls = [b" ".join([pieces[i] for i in some[k : k + 256]]).decode().lower() for k in range(0, len(some), 256)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.plain.encode_batch_fast(calls, add_special_tokens=False)])
            lengths[some] = np.diff(np.r_[-1, np.flatnonzero(self.closes[ids])])
            runs.append(ids)
        other = np.ones(len(pieces), bool)
        other[plain] = False
        other = np.flatnonzero(other)
        for low in range(0, len(other), 1 << 12):
            some = other[low : low + (1 << 12)].tolist()
            found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([pieces[i].decode() for i in some], add_special_tokens=False)]
            lengths[some] = [len(x) for x in found]
            runs += found
        flat = np.concatenate([np.zeros(0, np.int32), *runs])
        order = np.r_[np.array(plain, np.int64), other]
        place = np.empty(len(pieces), np.int64)
        place[order] = np.cumsum(lengths[order]) - lengths[order]
        ends = np.cumsum(lengths)
        return flat[np.repeat(place - (ends - lengths), lengths) + np.arange(len(flat))], lengths

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces begin and end, and the bytes with A-Z as a-z where that is all lower-casing does."""
        kind = _CLASS[data]
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                kind[at : at + len(s)] = _ODD
                at = raw.find(s, at + 1)
        before = np.empty_like(kind)
        before[1:] = kind[:-1] << 3
        before[offsets[:-1][offsets[:-1] < len(data)]] = _WHITE
        first = np.zeros(len(data), bool)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        edges = np.flatnonzero(_EDGE[before | kind] | first)
        begins = kind[edges] != _WHITE
        start, end = edges[begins], np.r_[edges[1:], len(data)][begins]
        lower = _LOWER[data]
        # a letter before a character beyond ASCII may be composed with it first; special tokens are case-sensitive
        held = np.flatnonzero((data[:-1] >= 65) & (data[:-1] <= 90) & ((data[1:] >= 128) | (kind[:-1] == _ODD)))
        lower[held] = data[held]
        return start, end, lower

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by end_id, and where each text's ids end."""
        return self.encode_bytes(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), end_id)

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, of texts in one array of bytes with their offsets."""
        if len(offsets) < 2:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if not self.by_pieces:
            texts = [data[a:z].tobytes().decode() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            found = [np.array([*e.ids, end_id], np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(found), np.cumsum([len(x) for x in found])
        start, end, lower = self._cut(data, offsets)
        padded = np.r_[lower, np.zeros(16, np.uint8)]
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        size = end - start
        low = eight[start] & _KEEP[np.minimum(size, 8)]
        high = eight[start + 8] & _KEEP[np.clip(size - 8, 0, 7)] | (np.minimum(size, 255).astype(U) << U(56))
        long = np.flatnonzero(size > PACKED)
        low[long], high[long] = np.arange(len(long), dtype=U), U(255 << 56)  # numbers of their own, for this block
        number = self.table.find(low, high)
        new = np.flatnonzero(number < 0)
        new = new[size[new] <= PACKED]
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            first = np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])]
            once = order[first]
            if self.table.n + len(once) > self.most:
                needed, half = np.unique(number[number >= 0]), len(offsets) // 2
                if len(needed) + len(once) <= self.most:
                    self._make_room(len(once), needed)
                elif half and half < len(offsets) - 1:
                    return self._halves(data, offsets, half, end_id)
                else:  # one text alone has more pieces than there is room for
                    self._grow(self.table.n + len(once))
                return self.encode_bytes(data, offsets, end_id)
            raw = lower.tobytes()
            ids, lengths = self._ids_of([raw[a:z] for a, z in zip(start[once].tolist(), end[once].tolist(), strict=True)])
            at = self.table.n
            self._remember(low[once], high[once], ids, lengths)
            number[order] = at + np.cumsum(first) - 1
        number = number.astype(np.int64)
        kept = np.ones(len(number), bool)
        kept[long] = False
        self.used[: self.table.n] += np.bincount(number[kept], minlength=self.table.n)
        number[long] = 0
        lengths = self.length[number] if self.table.n else np.zeros(len(number), np.int64)
        starts = self.start[number] if self.table.n else lengths
        pool = self.pool
        if len(long):
            raw = lower.tobytes()
            extra, sizes = self._ids_of([raw[a:z] for a, z in zip(start[long].tolist(), end[long].tolist(), strict=True)])
            pool = np.r_[pool[: self.filled], extra]
            lengths[long], starts[long] = sizes, self.filled + np.cumsum(sizes) - sizes
        # the end of each text is a piece of one id
        closing = np.searchsorted(start, offsets[1:])
        lengths, starts = np.insert(lengths, closing, 1), np.insert(starts, closing, 0)
        ends = np.cumsum(lengths)
        ids = pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
        ends = ends[closing + np.arange(len(closing))]
        ids[ends - 1] = end_id
        return ids, ends

    def _halves(self, data: np.ndarray, offsets: np.ndarray, half: int, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        cut = int(offsets[half])
        a, a_ends = self.encode_bytes(data[:cut], offsets[: half + 1], end_id)
        b, b_ends = self.encode_bytes(data[cut:], offsets[half:] - cut, end_id)
        return np.r_[a, b], np.r_[a_ends, b_ends + len(a)]

    def _grow(self, most: int) -> None:
        """Room for the pieces of one text that alone has more than there is room for."""
        n, low, high, used, lengths = self.table.n, self.table.low, self.table.high, self.used, self.length
        ids = self._gather(np.arange(n))
        self.most = most
        self._empty()
        self._remember(low[:n], high[:n], ids, lengths[:n])
        self.used[:n] = used[:n]


def _encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def _encode(path: str, end_id: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(path), 0
        for b in bounded(source):
            data, offsets = text_bytes(b.column("text"))
            low, n = 0, len(offsets) - 1
            while low < n:  # a block of texts at a time, one text at least
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BLOCK_BYTES, "right")) - 1)
                ids, ends = encoder.encode_bytes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], end_id)
                starts = np.r_[0, ends[:-1]].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(low, high - low), pa.array(starts + before), pa.array(np.diff(np.r_[0, ends]).astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids, pa.int32()))],
                    ["doc_id", "start_in_file", "n_tokens", "ids"],
                )
                before += int(ends[-1])
                low = high

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write docs' token ids below path: doc_id, start_in_file (ids before it in its file), n_tokens, ids.

    ``tokenizer``: path of a ``tokenizers`` file; one that cuts texts as ``_BY_PIECES`` says is run on distinct pieces only. A null text is empty and
    gives end_id alone. Null doc_ids come first; rows that repeat a doc_id are all written, by text. An empty table gives files without rows.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = docs.repartitionByRange(parts_for(docs, 16), "doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_encode(tokenizer, end_id), "doc_id long, start_in_file long, n_tokens long, ids array<int>")
    options = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(BLOOM_FALSE_POSITIVES), "orc.create.index": "true",
        "orc.row.index.stride": str(ROWS_PER_INDEX), "orc.stripe.size": str(STRIPE_BYTES), "compression": "zstd",
    }
    encoded.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before it.

    Filters on doc_id reach the ORC reader. Bases of files come from their totals: one row a file.
    """
    rows = spark.read.schema("doc_id long, start_in_file long, n_tokens long, ids array<int>").orc(path)
    rows = rows.select("doc_id", "start_in_file", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    bases = totals.selectExpr("file", "sum(total) OVER (ORDER BY file) - total AS base")  # as many rows as files
    return rows.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def _digest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in bounded(source):
        ids = b.column("ids")
        raw, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()) * 4
        crc = [zlib.crc32(raw[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens gives."""
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
