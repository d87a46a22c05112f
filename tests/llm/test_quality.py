import re
from collections import Counter

import numpy as np
from quillon.llm.quality import RULES, decode, encode, fit_label_model, quality


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(g)
    twice = {i + j for i, x in enumerate(g) if n[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    fail = len(w) < 50 or 100 * len(twice) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice), fail


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_equal_a_plain_reading(spark):
    texts = [None, "", " \n\t", "a b c a b c", "x", "a a a a", "é ü é # <|>\nq\n q\n\nq\n \n", "w " * 49, "one two three " * 40, "\n".join(f"l{i} of b{i * 7}" for i in range(60)), "b\x0bc\x0cd\re"]
    rows = list(enumerate(texts)) + [(None, "z"), (3, "again")]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, pattern string, kept int").repartition(2)
    got = Counter(tuple(r) for r in quality(df).select(COLUMNS).collect())
    assert got == Counter((d, *base(t)) for d, t in rows)


def test_empty_table(spark):
    assert quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_em_finds_accuracies_without_labels():
    r = np.random.default_rng(5)
    n, right, cast = 20_000, np.array([0.95, 0.9, 0.8, 0.7, 0.6]), np.array([0.9, 0.5, 0.9, 0.8, 0.9])
    truth = np.where(r.random(n) < 0.7, 1, -1)
    v = np.where(r.random((n, 5)) < right, truth[:, None], -truth[:, None]) * (r.random((n, 5)) < cast)
    codes, counts = np.unique(encode(v), return_counts=True)
    model = fit_label_model(decode(codes, 5), counts)
    assert np.abs(model.accuracies() - right).max() < 0.04 and abs(model.prior - 0.7) < 0.04
    assert ((model.posterior(v) >= 0.5) == (truth > 0)).mean() > (v[:, 0] == truth).mean()


def plain_votes(t):
    """The ten rules over one text, by its characters."""
    t = t or ""
    n, chars, symbols, dup, repeats, _ = base(t)
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    joined = "".join(w)
    ascii_letters = sum(c.isascii() and c.isalpha() for c in t)
    lines = len([x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    per = max(n, 1)

    def between(x, good, bad, few=0):
        return 0 if n < few else 1 if x <= good else -1 if x >= bad else 0

    mean = chars / per
    return [
        -1 if n < 50 else 1 if n >= 80 else 0,
        1 if 3 <= mean <= 9 else -1 if mean < 2 or mean > 12 else 0,
        between(symbols / per, 0.05, 0.15),
        between(sum(any(c in "#*$%&|<>" for c in x) for x in w) / per, 0.05, 0.15),
        between(-sum(c > "\x7f" or c.isalpha() for c in joined) / max(chars, 1), -0.88, -0.82),
        between(repeats / per, 0.2, 0.4, 20),
        between(dup / max(lines, 1), 0.1, 0.3),
        between(sum("A" <= c <= "Z" for c in t) / max(ascii_letters, 1), 0.12, 0.4),
        between(-sum(x[-1] in ".!?" for x in w) / per, -0.03, -0.005, 20),
        between(sum("0" <= c <= "9" for c in t) / max(chars, 1), 0.08, 0.25),
    ]


def plain_posteriors(votes, rounds=200):
    """EM over the documents one by one, in plain Python."""
    prior, rules = 0.8, range(len(votes[0]))
    right = [[0.8, 0.8] for _ in rules]  # of a rule's cast votes: right on bad documents, on good ones
    for _ in range(rounds + 1):
        p = []
        for v in votes:
            good, bad = prior, 1 - prior
            for r in rules:
                if v[r]:
                    good *= right[r][1] if v[r] > 0 else 1 - right[r][1]
                    bad *= right[r][0] if v[r] < 0 else 1 - right[r][0]
            p.append(good / (good + bad))
        prior = min(max((sum(p) + 0.8) / (len(p) + 1), 0.01), 0.99)
        for r in rules:
            cast = [[1 + sum((x if y else 1 - x) for v, x in zip(votes, p, strict=True) if v[r] == s) for y in (0, 1)] for s in (-1, 1)]
            right[r] = [cast[0][0] / (cast[0][0] + cast[1][0]), cast[1][1] / (cast[0][1] + cast[1][1])]
    return p


def test_votes_and_posteriors_equal_plain_em(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()] + [None, "", "A1 " * 40_000, "é# " * 90]
    votes = [plain_votes(t) for t in texts]
    want = plain_posteriors(votes)
    got = {r.doc_id: r for r in quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].votes) == votes[i] and abs(got[i].p_good - want[i]) < 1e-6
        assert got[i].kept == (not base(t)[-1] and got[i].p_good >= 0.5)


def test_documents_at_the_threshold_stay(spark):
    letter = "abcdefghijklmnopqrstuvwxyz"
    good = ". ".join(f"plain{a} words{b} follow{a}{b} here" for a in letter[:6] for b in letter[:5])
    df = spark.createDataFrame([(1, good), (2, good), (2, good), (3, "12 " * 60)], "doc_id long, text string")
    p = {r.doc_id: r.p_good for r in quality(df).collect()}
    at = quality(df, keep_from=p[1]).collect()
    assert len(at) == 4 and {r.doc_id for r in at if r.kept} == {1, 2} and p[1] == p[2] < 1
    assert not any(r.kept for r in quality(df, keep_from=float(np.nextafter(p[1], 2))).collect())


def test_kept_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality(docs).join(labels, "doc_id").select("quality", "kept", "votes").collect()
    good, bad = [x.kept for x in rows if x.quality == 1], [x.kept for x in rows if x.quality == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.2
    assert all(len(x.votes) == len(RULES) for x in rows)
