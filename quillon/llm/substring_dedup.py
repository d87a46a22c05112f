"""Removal of repeated passages: seed and extend.

Seeds are winnowed anchors: of the hashes of all 6-word runs, the least of every 15 in a row, so
each 20-word window holds at least one anchor, and equal windows hold equal anchors at equal
places. Occurrences of one anchor are extended both ways, as far as any window around the anchor
reaches (14 words left, 20 right from its start), and compared by that extension:

* An occurrence whose extension occurs earlier too is a repeat as a whole: every window around it is.
* An anchor that occurs with several extensions leaves its first occurrence of each one open. The
  windows that have such an anchor as their least, and no repeat, are compared one by one, by hash.

Repeated windows that overlap or touch merge into maximal repeats of at least 20 words. Work and data
grow with the number of anchors, about an eighth of the words, never with pairs of documents:
copies within a map task are resolved there, so of any passage a task sends at most one occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import blobs
from quillon.llm.identity import identified
from quillon.llm.spool import Spool, parts_for, settle
from quillon.llm.wordhash import TOP, Ranges, grams, hash_words, mix, slide

U = np.uint64
WINDOW = 20
SEED = 6
#: Anchors, or windows, that a map task gathers before it sends them.
BLOCK = 1_000_000
#: An anchor with so many extensions in one block is dealt out by extension, not by anchor alone.
HOT = 64
_REPEAT, _OPEN = 0, 1


def _anchor_places(h: np.ndarray, ends: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words begin an anchor; each run's hash; the least hash of the window from each word
    on, 0 where none fits. ends: where each word's text ends."""
    n, at = len(h), np.arange(len(h))
    g = np.full(n, TOP, U)
    made = grams(h, seed)
    g[: len(made)] = made
    g[at + seed > ends] = TOP
    width = window - seed + 1
    least = np.zeros(n, U)
    if n >= width:
        least[: n - width + 1] = slide(g, width, True)
    least[at + window > ends] = 0
    padded = np.r_[np.zeros(width - 1, U), least]
    return (slide(padded, width, False) == g) & (g != TOP) & (g != 0), g, least


def _first_rows(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order: which open a group of equal keys, and each row's group's first row."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new, np.flatnonzero(new)[np.cumsum(new) - 1]


def _anchors(bins: int, window: int, seed: int):
    """Map (doc_id, text) to anchors by bin; kinds: 0 rows, 1 anchors that are hot, 2 hot rows, 3 repeats already known."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, ext, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((at, doc, ext, key))
            key, ext, doc, at = key[order], ext[order], doc[order], at[order]
            new, first = _first_rows(key, ext)
            same = (doc == doc[first]) & (at == at[first])
            again = ~new & ~same
            yield from blobs.batches(blobs.dealt(3, (mix(doc[again].view(U)) % U(bins)).astype(np.int32), doc[again], at[again]))
            key, ext, doc, at = key[new], ext[new], doc[new], at[new]
            _, first = _first_rows(key)
            count = np.bincount(first, minlength=len(key))[first]
            hot = count >= HOT
            yield from blobs.batches(blobs.dealt(2, (mix(key[hot] ^ mix(ext[hot])) % U(bins)).astype(np.int32), key[hot], ext[hot], doc[hot], at[hot]))
            names = np.unique(key[hot])
            yield from blobs.batches(blobs.dealt(1, (mix(names) % U(bins)).astype(np.int32), names))
            cold = ~hot
            yield from blobs.batches(blobs.dealt(0, (mix(key[cold]) % U(bins)).astype(np.int32), key[cold], ext[cold], doc[cold], at[cold]))

        for b in blobs.bounded(source):
            words = hash_words(b.column(1))
            counts = np.diff(words.first)
            begins, ends = np.repeat(words.first[:-1], counts), np.repeat(words.first[1:], counts)
            places = np.flatnonzero(_anchor_places(words.hash, ends, window, seed)[0])
            if not len(places):
                continue
            low = np.maximum(begins[places], places - (window - seed))
            high = np.minimum(ends[places], places + window)
            ranges = Ranges(words.hash)
            ext = mix(ranges.hash(low, high) + (places - low).astype(U) * U(0x9E3779B97F4A7C15))
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), counts)
            held.append((grams(words.hash, seed)[places], ext, ids[places], (places - begins[places]).astype(np.int32)))
            size += len(places)
            if size >= BLOCK:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _marks(doc: np.ndarray, at: np.ndarray, state: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(at.astype(np.int64) * 2 + state)], ["doc_id", "mark"])


def _compare_extensions(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map bins of anchors to marks: an anchor's place, and if it is a repeat or open."""
    for _, kinds in blobs.by_bin(source):
        for blob in kinds.get(3, []):
            yield _marks(*blobs.unpack(blob, np.int64, np.int32), _REPEAT)
        hot = np.unique(blobs.joined(kinds.get(1, []), U)[0])
        for kind in (0, 2):
            key, ext, doc, at = blobs.joined(kinds.get(kind, []), U, U, np.int64, np.int32)
            if not len(key):
                continue
            order = np.lexsort((at, doc, ext, key))
            key, ext, doc, at = key[order], ext[order], doc[order], at[order]
            new, first = _first_rows(key, ext)
            again = ~new & ((doc != doc[first]) | (at != at[first]))
            yield _marks(doc[again], at[again], _REPEAT)
            key, doc, at = key[new], doc[new], at[new]
            if kind == 0:
                _, first = _first_rows(key)
                several = (np.bincount(first, minlength=len(key))[first] > 1) | np.isin(key, hot)
                doc, at = doc[several], at[several]
            yield _marks(doc, at, _OPEN)


def _open_windows(bins: int, window: int, seed: int):
    """Map (doc_id, text, marks) to the windows of open anchors, by bin: kinds 0 rows, 3 repeats already known."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, key2, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((at, doc, key2, key))
            key, key2, doc, at = key[order], key2[order], doc[order], at[order]
            new, first = _first_rows(key, key2)
            again = ~new & ((doc != doc[first]) | (at != at[first]))
            yield from blobs.batches(blobs.dealt(3, (mix(doc[again].view(U)) % U(bins)).astype(np.int32), doc[again], at[again]))
            yield from blobs.batches(blobs.dealt(0, (mix(key[new]) % U(bins)).astype(np.int32), key[new], key2[new], doc[new], at[new]))

        for b in blobs.bounded(source):
            words = hash_words(b.column("text"))
            n = len(words.hash)
            counts = np.diff(words.first)
            begins, ends = np.repeat(words.first[:-1], counts), np.repeat(words.first[1:], counts)
            _, g, least = _anchor_places(words.hash, ends, window, seed)
            marks = b.column("marks")
            values = marks.flatten().to_numpy(zero_copy_only=False)
            place = np.repeat(words.first[:-1], np.diff(marks.offsets.to_numpy())) + values // 2
            fits = place < n
            repeat = np.zeros(n, bool)
            repeat[place[fits & (values % 2 == _REPEAT)]] = True
            repeats = np.r_[0, np.cumsum(repeat)]
            width = window - seed + 1
            opened = np.unique(place[fits & (values % 2 == _OPEN)])
            start = opened[:, None] - np.arange(width)
            inside = start >= begins[opened][:, None]
            inside &= least[np.maximum(start, 0)] == g[opened][:, None]
            start = np.unique(start[inside])
            start = start[repeats[start + width] == repeats[start]]
            if not len(start):
                continue
            ranges = Ranges(words.hash)
            key = ranges.hash(start, start + window)
            key2 = grams(words.hash, window)[start]
            ids = np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), counts)
            held.append((key, key2, ids[start], (start - begins[start]).astype(np.int32)))
            size += len(start)
            if size >= BLOCK:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _compare_windows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map bins of windows to marks of those that occur earlier too."""
    for _, kinds in blobs.by_bin(source):
        for blob in kinds.get(3, []):
            yield _marks(*blobs.unpack(blob, np.int64, np.int32), _OPEN)
        key, key2, doc, at = blobs.joined(kinds.get(0, []), U, U, np.int64, np.int32)
        if len(key):
            order = np.lexsort((at, doc, key2, key))
            key, key2, doc, at = key[order], key2[order], doc[order], at[order]
            _, first = _first_rows(key, key2)
            again = (doc != doc[first]) | (at != at[first])
            yield _marks(doc[again], at[again], _OPEN)


def _cut(window: int, seed: int, texts: bool):
    """Map (doc_id, text, marks) to what is left of each text. A mark is an anchor whose whole
    extension repeats, or a window that does."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blobs.bounded(source):
            ids, n_words, n_removed, digests, kept_texts, spans = b.column("doc_id"), [], [], [], [], []
            for text, marks in zip(b.column("text").cast(pa.binary()), b.column("marks"), strict=True):
                words = (text.as_py() or b"").split()
                n, gone, runs = len(words), 0, []
                if marks.is_valid and n >= window:
                    m = np.asarray(marks.values.to_numpy(zero_copy_only=False))
                    place, whole = m // 2, m % 2 == _REPEAT
                    low = np.where(whole, place - (window - seed), place)
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, np.clip(low, 0, n), 1)
                    np.add.at(change, np.minimum(place + window, n), -1)
                    cover = np.cumsum(change[:-1]) > 0
                    gone = int(cover.sum())
                    if gone:
                        edge = np.flatnonzero(np.diff(np.r_[False, cover, False]))
                        runs = edge.reshape(-1, 2).tolist()
                        words = [words[i] for i in np.flatnonzero(~cover).tolist()]
                kept = b" ".join(words)
                n_words.append(n), n_removed.append(gone), digests.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    kept_texts.append(kept), spans.append([{"start": a, "end": z} for a, z in runs])
            columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                columns += [pa.array(kept_texts, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept_text", "repeats"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, texts: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, and with ``texts`` also kept_text
    and repeats, the word runs cut out (start, end).

    Words are runs without ASCII white space, unchanged. Every word goes that a window of ``window``
    words covers whose words also start earlier: in a smaller doc_id, or earlier in the same text.
    Windows are judged on the input. Null and empty texts have no words; texts shorter than a window
    stay whole. Rows that repeat a doc_id with the same text are one document; with other texts they are documents of their
    own, in the order of their texts' hashes. Rows with a null doc_id stay whole. Further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    spool = Spool(spark, "substring-dedup")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    given = identified(docs, spool)
    docs = given.docs
    known = docs.where("doc_id is not null")
    bins = parts_for(docs)
    deal = lambda df: df.repartition(bins, "bin").sortWithinPartitions("bin", "kind")
    gather = lambda df: df.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))

    dealt = deal(known.mapInArrow(_anchors(bins, window, seed), blobs.SCHEMA))
    marks = spool.table("anchors", dealt.mapInArrow(_compare_extensions, "doc_id long, mark long"))
    settle(spark)
    open_docs = marks.where("mark % 2 = 1").select("doc_id").distinct()
    undecided = gather(marks.join(open_docs, "doc_id", "left_semi"))
    held = known.join(undecided.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "marks")
    dealt = deal(held.mapInArrow(_open_windows(bins, window, seed), blobs.SCHEMA))
    windows = spool.table("windows", dealt.mapInArrow(_compare_windows, "doc_id long, mark long"))
    settle(spark)
    repeats = gather(marks.where("mark % 2 = 0").union(windows))
    whole = docs.join(repeats.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "marks")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return given.restored(whole.mapInArrow(_cut(window, seed, texts), schema + ", kept_text string, repeats array<struct<start: long, end: long>>" * texts))
