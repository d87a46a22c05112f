"""N-gram Jaccard join through prefix trees.

Every text is the set of its distinct word 5-grams. Two texts link when their sets' Jaccard
similarity is at least 0.75. Sets are put in one global order: rare n-grams by hash, then frequent
ones by frequency. If two sets link, they share an n-gram among the first s - ceil(0.75 s) + 1 of
each, and what remains after their first common one must still reach the overlap needed. With m more
n-grams in either prefix they share m + 1 of them, so a set of whose prefix fewer occur elsewhere
has no link. Nor have two sets that share fewer, whatever each shares with others: of n-grams in few sets
all pairs of sets are counted; those in many sets join each set to a hub, and the hubs that a set
meets least often are passed over. Sets that pass these bounds fall into blocks (components of the candidate graph); each block
is stored as a trie of its sets, and each set is run down the trie: the overlap with a node is
computed once for all sets below it, and a subtree whose remaining lengths cannot reach the
needed overlap is cut off. Only links between distinct sets are looked for; copies with one set
are one class.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import blobs
from quillon.llm.components import components, join_groups
from quillon.llm.spool import Spool, input_bytes, parts_for, settle
from quillon.llm.wordhash import mix, shingle_sets

U = np.uint64
WORDS = 5
PERCENT = 75
#: Local counts from which an n-gram is reported as frequent; how many of the most frequent get a
#: place of their own in the order. Both change the work only, never a result.
LOCAL_DF, FREQUENT = 4, 1 << 18
#: Prefixes have so many percent of a set's n-grams more than one common n-gram takes.
MORE = 10
#: Postings that a map task gathers before it sends them.
BLOCK = 1_000_000
#: All pairs of sets are counted of n-grams in up to so many prefixes, or in fewer, so that pairs are at most so many times the postings.
PAIRED_DF, PAIRS = 16, 2
#: Sets, and n-grams in them, of one trie; a larger block is cut into pieces, each pair of which is one trie join.
TRIE_SETS, TRIE_GRAMS = 4096, 4_000_000
#: Up to so many candidate classes (40 bytes each) are broadcast to the scan that makes their sets.
BROADCAST_ROWS = 1_000_000
#: Bytes of sets that are sent to tries at a time, or the input's if that is more; what exceeds them goes in further rounds.
SENT_BYTES = 512 << 20


def _least_overlap(size: np.ndarray | int, percent: int):
    return (size * percent + 99) // 100


def _more(size):
    """Common n-grams that the prefix of a set of this size is made for."""
    return 1 + size * MORE // 100


def _describe():
    """Map texts to one row each (kind 0: id, set size, set fingerprint) and to locally frequent n-grams (kind 1)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counts() -> pa.RecordBatch:
            a = np.sort(np.concatenate(held))
            cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            n = np.diff(np.r_[cut, len(a)])
            keep = n >= LOCAL_DF
            return rows(1, a[cut[keep]].view(np.int64), n[keep], a[:0], a[:0])

        def rows(kind, ids, n, high, low) -> pa.RecordBatch:
            ids = ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int64())
            pad = lambda x: pa.array(np.asarray(x, U).view(np.int64)) if len(x) else pa.nulls(len(ids), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), ids, pa.array(np.asarray(n, np.int64)), pad(high), pad(low)], ["kind", "id", "n", "fp_high", "fp_low"])

        for b in blobs.bounded(source):
            sets = shingle_sets(b.column(1), WORDS)
            prints = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            seen: set[int] = set()
            for s, p in zip(sets, prints, strict=True):
                if p not in seen:
                    seen.add(p)
                    held.append(s)
                    size += len(s)
            low = [p & (1 << 64) - 1 for p in prints]
            if len(b):
                yield rows(0, b.column(0).cast(pa.int64()), [len(s) for s in sets], [p >> 64 for p in prints], low)
            if size >= BLOCK:
                yield counts()
                held, size = [], 0
        if size:
            yield counts()

    return run


def _postings(bins: int, percent: int, frequent):
    """Map texts to packed postings of their prefixes: n-gram, set, size, place of the n-gram in the set. Of an n-gram
    32 bits are sent, and its bin tells more of it: two that can't be told apart count as one that is shared, which adds candidates only."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = frequent.value
        token, who, size, place, seen, n = [], [], [], [], set(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = mix(np.concatenate(token))
            b = (t % U(bins)).astype(np.int32)
            yield from blobs.batches(blobs.dealt(0, b, (t // U(bins)).astype(np.uint32), np.concatenate(who), np.concatenate(size), np.concatenate(place)))

        for b in blobs.bounded(source):
            for s in shingle_sets(b.column(1), WORDS):
                if not len(s):
                    continue
                p = xxhash.xxh3_128_intdigest(s.tobytes())
                if p in seen:
                    continue
                seen.add(p)
                m = len(s)
                k = m - _least_overlap(m, percent) + _more(m)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    often = common[at] == s
                    if often.any():
                        rare, often_s = s[~often], s[often]
                        s = rare if len(rare) >= k else np.r_[rare, often_s[np.argsort(rank[at[often]], kind="stable")]]
                token.append(s[:k])
                who.append(np.full(k, p & (1 << 64) - 1, U))
                size.append(np.full(k, m, np.int32))
                place.append(np.arange(k, dtype=np.int32))
                n += k
            if n >= BLOCK:
                yield from flush()
                token, who, size, place, seen, n = [], [], [], [], set(), 0
        if n:
            yield from flush()

    return run


def _shared(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map bins of postings to those whose n-gram is in the prefixes of several sets, with the number of these (df)."""
    for at_bin, kinds in blobs.by_bin(source):
        t, w, s, p = blobs.joined(kinds[0], np.uint32, U, np.int32, np.int32)
        order = np.lexsort((p, w, t))
        t, w, s, p = t[order], w[order], s[order], p[order]
        keep = np.ones(len(t), bool)  # the same set from two map tasks is one; two n-grams of a set that look alike stay two
        keep[1:] = (t[1:] != t[:-1]) | (w[1:] != w[:-1]) | (p[1:] != p[:-1])
        t, w, s, r = (np.int64(at_bin) << 32) | t[keep].astype(np.int64), w[keep], s[keep], s[keep] - p[keep]
        new = np.r_[True, t[1:] != t[:-1]]
        at = np.flatnonzero(new)
        df = np.repeat(lengths := np.diff(np.r_[at, len(t)]), lengths)
        more = df > 1
        columns = [pa.array(t[more]), pa.array(w[more].view(np.int64)), pa.array(s[more]), pa.array(r[more]), pa.array(df[more])]
        yield pa.RecordBatch.from_arrays(columns, ["gram", "fp", "size", "rest", "df"])


def _candidates(percent: int, paired: int):
    """Map postings, all of an n-gram in one partition, to edges (hot, a, b, n, bound) between sets that may link: n says in how many of the
    partition's n-grams.

    Two sets that link share as many n-grams of their prefixes as the smaller is made for. Either half of these are
    in up to ``paired`` prefixes: then bound is how many of those the two must share. Or more than half are hot, that is
    in more prefixes: then a is joined to b, a hub for each run of sets that may link; as long as a, and any other set,
    loses at most bound such n-grams, linked sets still have one in common."""

    def counted(hot: bool, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((b, a))
        a, b, bound = a[order], b[order], bound[order]
        at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        n = np.diff(np.r_[at, len(a)])
        columns = [pa.array(np.full(len(at), hot)), pa.array(a[at]), pa.array(b[at]), pa.array(n), pa.array(bound[at])]
        return pa.RecordBatch.from_arrays(columns, ["hot", "a", "b", "n", "bound"])

    def pairs(t, w, s, r, h) -> Iterator[pa.RecordBatch]:
        found = []
        for step in range(1, paired):
            i = np.flatnonzero(t[step:] == t[:-step])
            if not len(i):
                break
            i = i[w[i] != w[i + step]]
            j = i + step
            need = np.minimum(_more(s[i]), _least_overlap(s[j], percent))  # s[i] <= s[j]
            # of the n-grams shared, the first ``need`` are followed by at least all but need - 1 of the overlap
            may = (100 * s[i] >= percent * s[j]) & ((100 + percent) * (np.minimum(r[i], r[j]) + need - 1) >= percent * (s[i] + s[j]))
            i, j, need = i[may], j[may], need[may]
            found.append((w[i], w[j], np.maximum((need + 1) // 2, need - np.minimum(h[i], h[j]))))
        if found and sum(len(x[0]) for x in found):
            yield counted(False, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def stars(t, w, s, r, least) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        new = np.r_[True, t[1:] != t[:-1]]
        reach = np.minimum((100 + percent) * (r + _more(s) - 1) // percent - s, 100 * s // percent)
        group = np.cumsum(new)
        wide = int(max(reach.max(), s.max())) + 2
        best = np.maximum.accumulate(group * wide + np.maximum(reach, 0)) - group * wide
        starts = new.copy()
        starts[1:] |= best[:-1] < s[1:]
        hub = w[np.flatnonzero(starts)][np.cumsum(starts) - 1]
        far = hub != w
        if far.any():
            yield counted(True, w[far], hub[far], least[far] // 2 // 2)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in source if len(b)]
        if not given:
            return
        whole = pa.Table.from_batches(given)
        t, w, s, r, df, h = (whole.column(i).to_numpy() for i in range(6))
        order = np.lexsort((w, s, t))
        t, w, s, r, df, h = (x[order] if i < 2 else x[order].astype(np.int64) for i, x in enumerate((t, w, s, r, df, h)))
        cold = df <= paired
        yield from pairs(t[cold], w[cold], s[cold], r[cold], h[cold])
        least = _more(_least_overlap(s, percent))
        many = ~cold & (h > least // 2)
        yield from stars(t[many], w[many], s[many], r[many], least[many])

    return run


def _paired_df(shared: DataFrame) -> int:
    """Up to how many prefixes an n-gram is in of which all pairs are counted."""
    rows = {r.df: r.n for r in shared.groupBy("df").agg(F.count("*").alias("n")).where(F.col("df") <= PAIRED_DF).collect()}
    most, n = PAIRS * shared.count(), 0
    for df in range(2, PAIRED_DF + 1):
        n += rows.get(df, 0) * (df - 1) // 2
        if n > most:
            return df - 1
    return PAIRED_DF


def _sets(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates' texts to their sets. Rows that repeat a doc_id with another set are left out, with the same set, sent once."""
    seen: set[int] = set()
    for b in blobs.bounded(source):
        packed, keep = [s.tobytes() for s in shingle_sets(b.column("text"), WORDS)], []
        for i, (node, s) in enumerate(zip(b.column("node").to_numpy().view(U).tolist(), packed, strict=True)):
            if node not in seen and xxhash.xxh3_128_intdigest(s) & (1 << 64) - 1 == node:
                seen.add(node)
                keep.append(i)
        names = ["block", "node", "doc_id", "copies", "pieces", "mine"]
        b = pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(packed, pa.binary())], [*names, "grams"])
        yield b.take(pa.array(keep, pa.int64()))


class Trie:
    """Sets in the global order read backwards, frequent n-grams first, as a tree whose nodes are runs of n-grams. Of n-grams that
    are frequent alike, those of more of these sets come first. N-grams of one set alone overlap with nothing and are left out.
    frequent: the sorted n-grams that have a place of their own in the global order, and how frequent each is."""

    def __init__(self, sets: list[np.ndarray], frequent: tuple[np.ndarray, np.ndarray] | None = None):
        self.size = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        names, local, count = np.unique(every, return_inverse=True, return_counts=True)
        often = np.zeros(len(names), np.int64)
        if frequent is not None and len(frequent[0]):
            at = np.minimum(np.searchsorted(frequent[0], names), len(frequent[0]) - 1)
            often = np.where(frequent[0][at] == names, frequent[1][at], 0)
        alone = count == 1
        order = np.lexsort((names, -count, -often, alone))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.width = int((~alone).sum())
        self.sets = [np.sort(x[x < self.width]) for x in np.split(place[local], np.cumsum(self.size)[:-1])]
        self.common = np.array([len(s) for s in self.sets])
        leaf = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        parent, runs, depth, below, at = [-1], [self.sets[0][:0]], [0], [[]], [0] * len(sets)
        path = [0]
        for k, i in enumerate(leaf):
            s = self.sets[i]
            shared = 0
            if k:
                t = self.sets[leaf[k - 1]]
                m = min(len(s), len(t))
                differ = np.flatnonzero(s[:m] != t[:m])
                shared = int(differ[0]) if len(differ) else m
            while depth[path[-1]] > shared:
                last = path.pop()
                if depth[path[-1]] < shared:  # cut the run where the two sets part
                    cut = shared - depth[path[-1]]
                    parent.append(path[-1])
                    runs.append(runs[last][:cut])
                    depth.append(shared)
                    runs[last] = runs[last][cut:]
                    parent[last] = len(parent) - 1
                    path.append(len(parent) - 1)
            if len(s) > shared:
                parent.append(path[-1])
                runs.append(s[shared:])
                depth.append(len(s))
                path.append(len(parent) - 1)
            at[i] = path[-1]
        self.at = np.array(at)
        self.parent = np.array(parent)
        n = len(parent)
        level = np.zeros(n, np.int64)
        kids: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            kids[parent[v]].append(v)
        levels, front = [], kids[0]
        while front:
            levels.append(front)
            front = [x for v in front for x in kids[v]]
        #: Over the sets below a node: least size, most n-grams after the node.
        self.least, self.longest = np.full(n, 1 << 60), np.zeros(n, np.int64)
        np.minimum.at(self.least, self.at, self.size)
        np.maximum.at(self.longest, self.at, self.common)
        for front in reversed(levels):
            np.minimum.at(self.least, self.parent[front], self.least[front])
            np.maximum.at(self.longest, self.parent[front], self.longest[front])
        self.rest = self.longest - np.array(depth)
        self.levels = []
        for front in levels:
            f = np.array(front)
            lengths = np.array([len(runs[v]) for v in front])
            self.levels.append((f, np.concatenate([runs[v] for v in front]), np.cumsum(lengths) - lengths, lengths))

    def linked(self, i: int, percent: int) -> np.ndarray:
        """The other sets that link with set i."""
        has = np.zeros(self.width, np.int32)
        has[self.sets[i]] = 1
        n, common = int(self.size[i]), int(self.common[i])
        overlap = np.full(len(self.parent), -1, np.int64)
        overlap[0] = 0
        for nodes, run, starts, lengths in self.levels:
            above = overlap[self.parent[nodes]]
            # what the node and all below it could still add, before its n-grams are looked at
            can = above + np.minimum(self.rest[nodes] + lengths, common - above)
            open_ = np.flatnonzero((above >= 0) & ((100 + percent) * can >= percent * (n + self.least[nodes])))
            if not len(open_):
                continue
            sizes = lengths[open_]
            heads = np.cumsum(sizes) - sizes
            now = above[open_] + np.add.reduceat(has[run[np.repeat(starts[open_] - heads, sizes) + np.arange(sizes.sum())]], heads)
            nodes = nodes[open_]
            can = now + np.minimum(self.rest[nodes], common - now)
            alive = (100 + percent) * can >= percent * (n + self.least[nodes])
            overlap[nodes[alive]] = now[alive]
        mine = overlap[self.at]
        linked = np.flatnonzero((mine >= 0) & ((100 + percent) * mine >= percent * (n + self.size)))
        return linked[linked != i]


def _trie_join(percent: int, frequent):
    """Map sets, sorted by block, part and node, to (node, root, least, links, whole): the component within
    the trie, its smallest doc_id, the number of linked texts in it, and if the trie held the whole block."""

    def one(rows: list[tuple], whole: bool) -> Iterator[tuple]:
        side, nodes, ids, copies, sets = zip(*rows, strict=True)
        trie, root = Trie(list(sets), frequent.value), list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        side, n = np.array(side), np.array(copies)
        links = []
        for i in range(len(ids)):
            with_i = trie.linked(i, percent)
            if (side != 0).any():  # one piece against another
                with_i = with_i[side[with_i] != side[i]]
            links.append(int(n[with_i].sum()))
            for j in with_i.tolist():
                a, b = find(i), find(j)
                if a != b:
                    a, b = (a, b) if ids[a] < ids[b] else (b, a)
                    root[b] = a
        for i, node in enumerate(nodes):
            yield node, nodes[find(i)], ids[find(i)], links[i], whole

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            *n, whole = zip(*one(held, key[1] == ""), strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in n), pa.array(whole, pa.bool_())], ["node", "root", "least", "links", "whole"])

        for b in blobs.bounded(source):
            for block, part, side, node, doc, copies, packed in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if (block, part) != key:
                    if held:
                        yield done()
                    key, held = (block, part), []
                if not held or held[-1][1] != node:  # the same set from two map tasks is one
                    held.append((side, node, doc, copies, np.frombuffer(packed, U)))
        if held:
            yield done()

    return run


def ngram_jaccard_join(docs: DataFrame, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, n_links.

    n_shingles: distinct word 5-grams, A-Z as a-z (a shorter text counts once, as a whole).
    component_id: the smallest doc_id that links lead to, itself included. n_links: documents
    that link with it. Null and empty texts, and texts of white space, have no n-grams and link
    with nothing. Rows with a null doc_id are left out; rows that repeat a doc_id each count as a
    document. Further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    spool = Spool(spark, "ngram-join")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    bins = parts_for(docs)

    told = spool.table("described", docs.mapInArrow(_describe(), "kind int, id long, n long, fp_high long, fp_low long"))
    rows = told.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "fp_high", "fp_low")
    often = told.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(FREQUENT).toPandas()
    names = often["id"].to_numpy(np.int64).view(U)
    order = np.argsort(names)
    frequent = spark.sparkContext.broadcast((names[order], often["n"].to_numpy(np.int64)[order]))

    dealt = docs.mapInArrow(_postings(bins, percent, frequent), blobs.SCHEMA).repartition(bins, "bin").sortWithinPartitions("bin", "kind")
    shared = spool.table("shared", dealt.mapInArrow(_shared, "gram long, fp long, size int, rest int, df long"))
    paired = _paired_df(shared)
    settle(spark)  # only now: until a further job has run, Spark holds on to the last one's shuffle
    smallest = F.ceil(F.col("size") * percent / 100)
    enough = shared.groupBy("fp", "size").agg(F.count("*").alias("n"), F.count_if(F.col("df") > paired).alias("hot")).where(F.col("n") >= 1 + F.floor(smallest * MORE / 100))
    likely = shared.join(enough.drop("n"), ["fp", "size"]).select("gram", "fp", "size", "rest", "df", "hot").repartition(bins, "gram")
    weighed = likely.mapInArrow(_candidates(percent, paired), "hot boolean, a long, b long, n long, bound long")
    weighed = spool.table("weighed", weighed.groupBy("hot", "a", "b").agg(F.sum("n").alias("n"), F.max("bound").alias("bound")).where("hot or n >= bound"))
    met = F.sum("n").over(W.partitionBy("a").orderBy("n", "b").rowsBetween(W.unboundedPreceding, W.currentRow))
    edges = spool.table("edges", weighed.where("not hot").select("a", "b").union(weighed.where("hot").withColumn("met", met).where("met > bound").select("a", "b")))
    blocks = components(edges, spool, "blocks")

    classes = spool.table("classes", rows.where("n_shingles > 0").groupBy("fp_high", "fp_low").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("size")))
    members = spool.table("members", classes.join(blocks, classes.fp_low == blocks.node).select("root", "node", "rep", "copies", "size"))
    n = members.count()
    sizes = members.groupBy("root").agg(F.count("*").alias("sets"), F.sum("size").alias("grams"))
    pieces = sizes.withColumn("pieces", F.ceil(F.greatest(F.col("sets") / TRIE_SETS, F.col("grams") / TRIE_GRAMS)).cast("int"))
    sent = pieces.agg(F.sum(F.col("grams") * F.col("pieces"))).first()[0] or 0
    settle(spark)
    rounds = max(1, -(-8 * sent // max(SENT_BYTES, input_bytes(docs))))
    chosen = join_groups(members, pieces.drop("grams"), "root", "sets", n).select(F.col("root").alias("block"), "node", F.col("rep").alias("doc_id"), "copies", "pieces")
    chosen = chosen.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))

    def part(other: Column) -> Column:
        return F.when(F.col("pieces") == 1, "").otherwise(F.concat_ws("-", F.least("mine", other), F.greatest("mine", other)))

    def due(k: int, other: Column) -> Column:
        return F.pmod(F.xxhash64("block", part(other)), F.lit(rounds)) == k

    linked = []
    for k in range(rounds):
        others = F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), functools.partial(due, k))
        now = chosen.where(F.size(others) > 0)
        found = docs.join(F.broadcast(now) if n <= BROADCAST_ROWS else now, "doc_id").select("block", "node", "doc_id", "copies", "pieces", "mine", "text")
        # each text becomes a set once a round; a set of a block in pieces then goes to every pair of pieces with its own
        sets = found.mapInArrow(_sets, "block long, node long, doc_id long, copies long, pieces int, mine int, grams binary").withColumn("other", F.explode(others))
        sets = sets.select(
            "block", part(F.col("other")).alias("part"),
            F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
            "node", "doc_id", "copies", "grams",
        )
        sets = sets.repartition(bins, "block", "part").sortWithinPartitions("block", "part", "node")
        linked.append(spool.table(f"linked-{k}", sets.mapInArrow(_trie_join(percent, frequent), "node long, root long, least long, links long, whole boolean")))
        settle(spark)
    linked = functools.reduce(DataFrame.union, linked)

    roots = linked.where("whole").select("node", F.col("least").alias("component"))
    cut = linked.where("not whole")
    if not cut.isEmpty():
        across = components(cut.select(F.col("node").alias("a"), F.col("root").alias("b")), spool, "across")
        within = cut.groupBy("node").agg(F.min("least").alias("least"))
        joined = spool.table("joined", within.join(across, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
        least = joined.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
        roots = roots.union(join_groups(joined, least, "root", "n", joined.count()).select("node", "component"))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = classes.join(roots.join(links, "node"), classes.fp_low == F.col("node"), "left")
    per_class = per_class.select("fp_high", "fp_low", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    settle(spark)
    out = rows.join(per_class, ["fp_high", "fp_low"], "left")
    linkable = F.col("n_shingles") > 0
    return out.select(
        "doc_id", "n_shingles",
        F.when(linkable, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linkable, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
