"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index is a written table of postings (term, doc_id, pos) of training tokens, left where the documents' scan made
them, so building it shuffles no posting; one posting of an end marker a document records its length. It holds
the tokens of a given vocabulary, such as that of one benchmark, or all tokens, and then serves any benchmark. A
test phrase is looked up from its rarest terms: their postings, less their places in the test text, are intersected on
(document, alignment), and only alignments on which they agree are compared with the other terms' postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.identity import Identified, identified
from quillon.llm.spool import Spool

WINDOW = 10
#: Postings lists that a lookup intersects before it compares whole phrases.
RAREST = 2
#: Rows up to which test terms, phrases and candidate documents are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Not a token: the pattern below keeps line feeds out of tokens.
_END = "\n"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_NOT_TOKEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Lower-case A-Z, then runs of digits, letters a-z and all beyond ASCII; null gives none."""
    lower = F.translate(text, _LETTERS.upper(), _LETTERS)
    return F.coalesce(F.array_remove(F.split(lower, _NOT_TOKEN), ""), F.array().cast("array<string>"))


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class PositionalIndex:
    """postings: (term, doc_id, pos); of an end marker the position is its document's length."""

    postings: DataFrame
    spool: Spool

    @staticmethod
    def build(docs: DataFrame, spool: Spool, vocabulary: DataFrame | None = None) -> PositionalIndex:
        """Index the tokens of docs (doc_id, text): all, or those that vocabulary (term) has."""
        found = docs.select("doc_id", F.posexplode(F.concat(tokens(F.col("text")), F.array(F.lit(_END)))).alias("pos", "term"))
        if vocabulary is not None:
            listed = spool.table("vocabulary", vocabulary.select("term").union(docs.sparkSession.sql("SELECT '\\n'")).distinct())
            found = found.join(_near(listed, listed.count()), "term", "left_semi")
        return PositionalIndex(spool.table("postings", found.select("term", "doc_id", "pos")), spool)

    @staticmethod
    def open(spark: SparkSession, path: str, spool: Spool) -> PositionalIndex:
        """An index that was built before, at the path of its postings."""
        return PositionalIndex(spark.read.schema("term string, doc_id long, pos int").parquet(path), spool)

    def lengths(self) -> DataFrame:
        """(doc_id, n_words)."""
        return self.postings.where(F.col("term") == _END).select("doc_id", F.col("pos").cast("long").alias("n_words"))

    def lists(self, terms: DataFrame, n: int) -> DataFrame:
        """Postings joined with terms (term and any others; n rows)."""
        return self.postings.join(_near(terms, n), "term")

    def counted(self, terms: DataFrame, name: str) -> DataFrame:
        """terms (term and any others) with n, how many postings each has; written, and with how many rows."""
        asked = self.spool.table(f"{name}-terms", terms.select("term").distinct())
        counts = self.lists(asked, asked.count()).groupBy("term").agg(F.count("*").alias("n"))
        return self.spool.table(name, terms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")))

    def windows(self, texts: DataFrame, window: int, rarest: int = RAREST) -> DataFrame:
        """Exact occurrences (item_id, doc_id, start, size) of each run of ``window`` words of
        texts (item_id, words); of all words of a shorter one.

        Lists are intersected on a text's alignment with a document, start less place in the
        text, so a posting counts once for all windows of the text that it is in.
        """
        spool = self.spool
        each = self.counted(texts.select("item_id", F.size("words").alias("length"), F.posexplode("words").alias("at", "term")), "places")
        n = each.count()
        ahead = W.partitionBy("item_id").orderBy("at").rowsBetween(0, window - 1)
        cut = each.select("item_id", "length", F.col("at").alias("first"), F.collect_list(F.struct("n", "at")).over(ahead).alias("run"))
        cut = cut.where(f"first = 0 OR first + {window} <= length")
        # a term that is nowhere: the window is nowhere
        cut = cut.where("forall(run, x -> x.n > 0)").selectExpr("item_id", "first", "size(run) AS size", f"transform(slice(array_sort(transform(run, x -> struct(x.n AS n, x.at AS at))), 1, {rarest}), x -> x.at) AS keys")
        cut = spool.table("windows-of-texts", cut)
        keys = spool.table("keys", cut.select("item_id", F.explode("keys").alias("at")).distinct().join(each.select("item_id", "at", "term"), ["item_id", "at"]))
        lists = self.lists(keys, n).selectExpr("item_id", "doc_id", "pos - at AS shift", "at")
        agree = lists.groupBy("item_id", "doc_id", "shift").agg(F.collect_set("at").alias("seen"))
        # an alignment meets the windows of which it has the rarest term, not all windows of its text
        agree = agree.select("item_id", "doc_id", "shift", "seen", F.explode("seen").alias("rarest"))
        likely = agree.join(_near(cut.withColumn("rarest", F.col("keys")[0]), n), ["item_id", "rarest"])
        likely = likely.where("shift + first >= 0 AND forall(keys, k -> array_contains(seen, k))")
        likely = spool.table("likely", likely.select("item_id", "doc_id", "shift", "first", "size"))
        wanted = likely.select("item_id", "doc_id", "shift", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("at")).distinct()
        wanted = wanted.join(_near(each.select("item_id", "at", "term"), n), ["item_id", "at"]).withColumn("pos", F.col("shift") + F.col("at"))
        wanted = spool.table("wanted", wanted)
        within = spool.table("within", likely.select("doc_id").distinct())
        asked = spool.table("wanted-terms", wanted.select("term").distinct())
        held = self.lists(asked, asked.count()).join(_near(within, within.count()), "doc_id", "left_semi")
        there = wanted.join(held, ["doc_id", "pos", "term"]).groupBy("item_id", "doc_id", "shift").agg(F.collect_set("at").alias("seen"))
        full = likely.join(there, ["item_id", "doc_id", "shift"]).where("forall(sequence(first, first + size - 1), k -> array_contains(seen, k))")
        return full.selectExpr("item_id", "doc_id", "shift + first AS start", "size")

    def near(self, groups: DataFrame, slop: int) -> DataFrame:
        """Proximity matches (phrase_id, doc_id, start): every word of a group (phrase_id, words), in
        any order, within size + slop tokens from start on, where an occurrence of its rarest word lies."""
        spool = self.spool
        each = self.counted(groups.select("phrase_id", F.size(F.array_distinct("words")).alias("size"), F.explode(F.array_distinct("words")).alias("term")), "groups")
        n = each.count()
        # a group with a word that is nowhere matches nothing
        each = each.selectExpr("phrase_id", "term", "size", "min(n) OVER (PARTITION BY phrase_id) AS least", "row_number() OVER (PARTITION BY phrase_id ORDER BY n, term) AS rank")
        each = spool.table("ranked", each.where("least > 0"))
        lists = self.lists(each.where("rank = 1").select("phrase_id", "size", "term"), n)
        starts = lists.selectExpr("phrase_id", "size", "doc_id", f"explode(sequence(greatest(0, pos - size - {slop} + 1), pos)) AS start").distinct()
        starts = spool.table("starts", starts)
        within = spool.table("near-docs", starts.select("doc_id").distinct())
        held = self.lists(each.select("phrase_id", "term"), n).join(_near(within, within.count()), "doc_id", "left_semi")
        hits = held.withColumnRenamed("doc_id", "d").withColumnRenamed("phrase_id", "p")
        hits = starts.join(hits, (F.col("phrase_id") == F.col("p")) & (F.col("doc_id") == F.col("d")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("size") + slop))
        return hits.groupBy("phrase_id", "doc_id", "start", "size").agg(F.count_distinct("term").alias("n")).where("n = size").select("phrase_id", "doc_id", "start")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", index: PositionalIndex | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Tokens are lower-cased runs of digits, letters and characters beyond ASCII. A hit is a
    document's word inside any occurrence of a window of an item: ``window`` words in a row, or all
    words of a shorter item. items: the ids of items with an occurring window, sorted as strings;
    items_sha256: their digest, comma-joined. Null texts have no words, and items without words
    match nothing. Null item_ids are left out, and null doc_ids too; rows that repeat a doc_id with the same text are one
    document and give one row, with other texts they are documents of their own and give a row each. Further columns are ignored; empty tables give no hits or no rows.
    index: one of all tokens of docs that was built before; without it one of the items' tokens is built.
    """
    spark = docs.sparkSession
    spool = Spool(spark, "decontaminate")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    given = identified(docs, spool) if index is None else Identified(docs, None, False)
    docs = given.docs.distinct() if given.names is not None else given.docs
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    words = items.select("item_id", tokens(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    # items may repeat an id with other words
    words = spool.table("items", words.withColumnRenamed("item_id", "name").withColumn("item_id", F.sha2(F.concat_ws(_END, "name", F.array_join("words", _END)), 256)))
    index = PositionalIndex.build(docs, spool, words.select(F.explode("words").alias("term"))) if index is None else PositionalIndex(index.postings, spool)
    found = spool.table("found", index.windows(words.select("item_id", "words"), window))
    hit = found.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    hit = hit.groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    named = found.select("item_id", "doc_id").distinct().join(_near(words.select("item_id", "name"), words.count()), "item_id").select("doc_id", "name").distinct()
    named = named.groupBy("doc_id").agg(F.array_sort(F.collect_list("name")).alias("items"))
    out = index.lengths().distinct().join(hit, "doc_id", "left").join(named, "doc_id", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return given.restored(out).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), listed.alias("items"),
    )
