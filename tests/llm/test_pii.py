import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from quillon.llm.pii import GENERATORS, KINDS, Boosted, base_spans, examples, find_personal_data, labelled, listed, luhn, proposals, redacted, spans, train

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The patterns themselves, with their checks."""
    out = []
    for i, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), i, m.end(), k))
    return [(a, b, k) for a, _, b, k in sorted(out)]


PIECES = st.lists(st.sampled_from(["a", "Z", "9", "1", "12", "255", "256", "001", ".", ".", "-", " ", "@", "@", "+", "+1", "(", ")", "é", "4111111111111111", "4111 1111-1111 1111", "_", "%", "\n", "x.y", "00"]), max_size=25).map("".join)


@settings(max_examples=1500, deadline=None)
@given(PIECES)
def test_base_spans_equal_the_patterns(text):
    assert base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "a.b@" * 80_000, "1 " * 150_000, "A1" * 100_000, "x at y dot " * 20_000, "-" * 200_000, "a" * 200_000 + " dot"):
        base_spans(t)
        spans(t, train())


def test_held_out_accuracy():
    x, y, g = labelled(examples(3000, 99))
    chosen = train().redact(x, g)
    assert y[chosen].mean() > 0.93 and chosen[y == 1].mean() > 0.85
    p = train().probability(x)
    for low in (0.0, 0.8):  # calibrated: in bands of probability, the mean is the share that is right
        band = (p >= low) & (p < low + 0.2)
        assert abs(p[band].mean() - y[band].mean()) < 0.1


def test_trees_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((Boosted().fit(x, y).score(x) > 0) == y).mean() > 0.95


def test_secrets_and_lookalikes():
    t = 'the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff; call me at (499) 555-6503 or a@b.co'
    found = spans(t, train())
    assert [k for *_, k in found] == ["secret", "phone", "email"]
    assert redacted(t, found).startswith('the token = "[SECRET]" and commit 24be') and redacted(t, found).endswith("call me at [PHONE] or [EMAIL]")
    assert {k for k, *_ in GENERATORS.values()} <= set(KINDS)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (None, "a@b.c"), (-3, "a@b.c"), (-3, "a@b.c"), (-4, "x " * 50_000 + "\U0001f389 a@b.c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int").repartition(3)
    got = sorted((tuple(r) for r in find_personal_data(df, texts=False).collect()), key=str)
    want = []
    for d, t in rows:
        base = plain(t or "")
        n = [sum(k == x for *_, k in base) for x in ("email", "ip", "card", "phone")]
        every = spans(t or "", train())
        assert set(base) <= set(every)
        want.append((d, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every)))
    assert got == sorted(want, key=str)
    assert find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planted_rows_by_kind(spark):
    """Recall on the personal data and tokens planted in the synthetic table, and no other secret or account found in its prose."""
    found, planted = 0, 0
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect():
        text = r.text or ""
        every = spans(text, train())
        tokens = [(m.start(1), m.end(1), "secret") for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text)]
        planted += len(tokens)
        found += len(set(tokens) & set(every))
        assert {s for s in every if s not in tokens} == set(base_spans(text))
    assert planted > 50 and found == planted


def test_secrets_may_hold_base_spans():
    card = "4111111111111111"
    key = f"ab{card}cdef0123456789abcdef"
    t = f'token = "{key}" and {card}'
    assert spans(t, train()) == [(9, 9 + len(key), "secret"), (11, 27, "card"), (len(t) - 16, len(t), "card")]
    assert redacted(t, spans(t, train())) == 'token = "[SECRET]" and [CARD]'


def test_long_secrets_and_late_digits():
    r = np.random.default_rng(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-"
    for n in (201, 256, 400, 2000):
        for key in ("".join(r.choice(list("0123456789abcdef"), n)), "".join(r.choice(list(letters + "0123456789"), n - 2)) + "7x=="):
            for head in ('token = "', "Authorization: Bearer "):
                t = f"{head}{key}{'"' if '"' in head else ''} and more"
                assert spans(t, train()) == [(len(head), len(head) + len(key), "secret")]
    late = "".join(r.choice(list(letters), 70)) + "5"
    assert any(late == f"secret: {late}"[a:b] for a, b, _ in proposals(f"secret: {late}"))
    assert not proposals("a" * 300)
