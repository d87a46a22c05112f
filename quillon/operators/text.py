"""Tokens, term statistics and BM25."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.columns import c

K1, B = 1.2, 0.75
#: What is between tokens.
BETWEEN = r"[^\p{L}\p{N}]+"


def _count(tokens_: Column | str, term: str) -> Column:
    return F.size(tokens_) - F.size(F.array_remove(tokens_, term))


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits in lower case; null has none."""
    return F.coalesce(F.array_remove(F.split(F.lower(c(text)), BETWEEN), ""), F.array().cast("array<string>"))


def spaced(text: Column | str) -> Column:
    """A text's tokens as one string, with a space between them; null stays."""
    return F.trim(F.regexp_replace(F.lower(c(text)), BETWEEN, " "))


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, cut as texts are."""
    return sorted({t for t in "".join(x if x.isalpha() or unicodedata.category(x)[0] == "N" else " " for x in query.lower()).split()})


def expanded(terms: list[str], synonyms: dict[str, list[str]] | None = None, stop_words: set[str] | None = None) -> list[list[str]]:
    """For each term that is no stop word: the term and its synonyms. A query of stop words alone keeps them."""
    kept = [t for t in terms if t not in (stop_words or ())] or terms
    return [list(dict.fromkeys([t, *(synonyms or {}).get(t, [])])) for t in kept]


def typos(length: Column) -> Column:
    """How many edits a term of this length may differ by: one from five characters on, two from nine."""
    return F.when(length >= 9, 2).when(length >= 5, 1).otherwise(0)


def matching_terms(vocabulary: DataFrame, terms: list[str], prefix_last: bool = True) -> DataFrame:
    """(asked, term, edits) of the vocabulary's terms (term) that a query's terms match: equal, within the typos allowed and
    with the same first character, or, for the last one, as its beginning (edits 0)."""
    asked = vocabulary.sparkSession.createDataFrame([(t, i == len(terms) - 1) for i, t in enumerate(terms)], "asked string, last boolean")
    first = F.substring("asked", 1, 1).alias("first")
    pairs = vocabulary.select("term", F.substring("term", 1, 1).alias("first")).join(F.broadcast(asked.select("asked", "last", first)), "first")  # a query's terms are few
    edits = F.levenshtein("asked", "term", 2)
    begins = F.col("last") & F.lit(prefix_last) & F.startswith("term", F.col("asked"))
    near = pairs.withColumn("edits", F.when(begins, 0).otherwise(edits))
    return near.where((F.col("edits") >= 0) & (begins | (F.col("edits") <= typos(F.length("asked"))))).select("asked", "term", "edits")


#: So many tokens at a time are counted by a Python worker, or one document's.
COUNTED_TOKENS = 2_000_000


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, *other columns, term, tf, dl) of every term of every document. A document's terms are counted where it is
    read, as Arrow batches in runs sorted by term, so nothing is shuffled."""
    others = [key, *[x for x in docs.columns if x not in (text, key)]]
    most = COUNTED_TOKENS

    def count(batches):  # pickled whole: workers need not find this package
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            batch = batch.filter(pc.not_equal(batch.column("_spaced"), ""))  # here, since a filter in the plan would cut each text twice
            dl = pc.add(pc.count_substring(batch.column("_spaced"), " "), 1).to_numpy(zero_copy_only=False).astype("int64")
            before, start = np.concatenate(([0], np.cumsum(dl))), 0
            while start < len(dl):
                end = max(start + 1, int(np.searchsorted(before, before[start] + most, "right")) - 1)
                part, n, size = batch.slice(start, end - start), end - start, dl[start:end]
                start = end
                terms = pc.split_pattern(part.column("_spaced"), " ").flatten().dictionary_encode()
                order = pc.array_sort_indices(terms.dictionary).to_numpy()
                place = np.empty(len(order), "int64")
                place[order] = np.arange(len(order))
                code = place[terms.indices.to_numpy()] * n + np.repeat(np.arange(n), size)  # by term, then document
                code.sort()
                first = np.flatnonzero(np.diff(code, prepend=-1))
                term, doc = np.divmod(code[first], n)
                tf = np.diff(first, append=len(code))
                words = terms.dictionary.take(pa.array(order))
                for i in range(0, len(first), 65536):
                    at, d = pa.array(doc[i : i + 65536]), doc[i : i + 65536]
                    found = [*[part.column(x).take(at) for x in others], words.take(pa.array(term[i : i + 65536])), pa.array(tf[i : i + 65536].astype("int32")), pa.array(size[d].astype("int32"))]
                    yield pa.RecordBatch.from_arrays(found, [*others, "term", "tf", "dl"])

    each = docs.select(*others, spaced(text).alias("_spaced"))
    schema = each.select(*others, F.lit("").alias("term"), F.lit(0).alias("tf"), F.lit(0).alias("dl")).schema
    return each.mapInArrow(count, schema)


def term_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term. Of a document's terms in order, each one's first differs
    from the term before it, so partial counts by term alone are shuffled, no document's key."""
    each = docs.select(F.sort_array(tokens(text)).alias("term"))
    before = F.concat(F.array(F.lit("")), F.slice("term", 1, F.greatest(F.size("term") - 1, F.lit(0)))).alias("before")
    each = each.where(F.size("term") > 0).select(F.explode(F.arrays_zip("term", before)).alias("t")).select("t.term", "t.before")
    return each.groupBy("term").agg(F.count_if(F.col("term") != F.col("before")).alias("df"), F.count("*").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, key: str, text: str, query: str, by: str | None = None) -> DataFrame:
    """docs that match any term, without their text, with score. by: statistics within each value of this column, not over all.

    One scan gives sizes and document frequencies of the few query terms (partial sums only): one row, which is
    broadcast, or one a value of ``by``. A second one scores documents that have a term's letters at all.
    """
    terms = query_terms(query)
    if not terms:
        return docs.drop(text).withColumn("score", F.lit(1.0))
    has = [F.count_if(F.array_contains("_tokens", t)).alias(f"df_{i}") for i, t in enumerate(terms)]
    sized = docs.select(*([by] if by else []), tokens(text).alias("_tokens"))
    stats = (sized.groupBy(by) if by else sized.groupBy()).agg(F.count("*").alias("_n"), F.avg(F.size("_tokens")).alias("_avg"), *has)
    others = [x for x in docs.columns if x != text]
    lower = F.lower(text)
    maybe = functools.reduce(lambda a, b: a | b, [F.contains(lower, F.lit(t)) for t in terms])
    scored = docs.where(maybe).select(*others, tokens(text).alias("_tokens")).where(F.arrays_overlap("_tokens", F.array(*map(F.lit, terms))))
    scored = scored.select(*others, F.size("_tokens").alias("_dl"), *[_count("_tokens", t).cast("double").alias(f"_tf_{i}") for i, t in enumerate(terms)])
    scored = scored.join(stats, by) if by else scored.join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"_tf_{i}")
        score = score + idf(F.col("_n"), F.col(f"df_{i}")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return scored.select(*others, score.alias("score"))


def whole_word(term: str) -> str:
    """A pattern for the term as it stands, whatever characters it has, not inside a longer word; letters match in either case."""
    return f"(?i)(?<!\\w)({re.escape(term)})(?!\\w)"


def highlight(text: Column | str, term: str, before: str = "<em>", after: str = "</em>") -> Column:
    plain = lambda x: x.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c(text), whole_word(term), f"{plain(before)}$1{plain(after)}")


def match_positions(text: Column | str, term: str) -> Column:
    """array<struct<start, length>> of a term's places in a text, in characters from 0."""
    parts, n = F.split(c(text), whole_word(term), -1), len(term)
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda s, p: F.concat(s, F.array(F.coalesce(F.element_at(F.when(F.size(s) > 0, s), -1) + n, F.lit(0)) + F.length(p))))
    return F.transform(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), lambda e: F.struct(e.alias("start"), F.lit(n).alias("length")))


def crop(text: Column | str, term: str, width: int = 60) -> Column:
    """Text around the first place of a term; its beginning where the term isn't."""
    at = F.locate(term, F.lower(c(text)))
    return F.substring(c(text), F.greatest(F.lit(1), at - width // 2).cast("int"), F.lit(width))
