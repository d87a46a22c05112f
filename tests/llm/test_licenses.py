import random
import re

from quillon.llm.licenses import TEMPLATES, Templates, bands_for, scan_licenses


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text):
    """Licenses a template of which has three quarters of its 5-grams in a window of three steps, wherever that begins on the grid."""
    t, found = Templates(TEMPLATES), set()
    g = grams(words(text))
    sets = [set(grams(words(x))) for xs in TEMPLATES.values() for x in xs]
    for step, members in t.steps.items():
        for low in range(0, len(g), step):
            have = set(g[low : low + 3 * step])
            found |= {t.names[i] for i in members if 100 * len(have & sets[i]) >= 75 * len(sets[i])}
    return ",".join(sorted(found))


def made(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + words(" ".join(x for xs in TEMPLATES.values() for x in xs))[:60]
    rows = []
    for d in range(n):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 4, 50, 300]))]
        for _ in range(r.choice([0, 1, 2])):
            x = r.choice(r.choice(list(TEMPLATES.values()))).split()
            for _ in range(r.choice([0, 0, 1, 2])):
                x[r.randrange(len(x))] = r.choice(["", "changed", "x y"])
            at = r.randrange(len(w) + 1)
            w[at:at] = x
        rows.append((d, r.choice([" ", "\n", " * "]).join(w)))
    return rows


def test_finds_what_a_full_scan_finds(spark):
    rows = made(400, 2) + [(900, None), (901, ""), (902, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (903, "z " * 20_000 + "licensed UNDER the apache license version 2 0")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, matches int").repartition(3)
    got = {r.doc_id: r.licenses for r in scan_licenses(df).collect()}
    want = {d: brute(t) for d, t in rows}
    assert len(got) == len(rows) and got[902] == "MIT" and got[903] == "Apache-2.0" and got[None] == "CC-BY-NC-4.0"
    pairs = [(d, n) for d, x in want.items() for n in x.split(",") if n]
    assert all(set(got[d].split(",")) <= set(want[d].split(",")) for d in want)  # nothing that isn't there
    assert sum(n in got[d].split(",") for d, n in pairs) >= 0.995 * len(pairs) and len(pairs) > 200


def test_ties_repeats_and_empty_tables(spark):
    mit = "Released under the MIT License."
    text = f"{mit} {'q ' * 400} {mit}"
    df = spark.createDataFrame([(1, text), (1, text), (None, mit), (2, "other")], "doc_id long, text string").repartition(2)
    rows = scan_licenses(df).collect()
    assert len(rows) == 4 and len(scan_licenses(df.limit(0)).collect()) == 0
    twice = [r for r in rows if r.doc_id == 1]
    assert twice[0] == twice[1] and twice[0].n_licenses == 1
    assert all(m.start < 20 for m in twice[0].matches)  # of equal windows the first is told


def test_whole_template_lies_in_a_window():
    for _, xs in TEMPLATES.items():
        for x in xs:
            for before in range(0, 40, 3):
                assert brute("q " * before + x + " q" * 7)


def test_matches_tell_where(spark):
    r = scan_licenses(spark.createDataFrame([(1, "a b Released under the MIT License. c")], "doc_id long, text string")).first()
    assert [tuple(m) for m in r.matches] == [("MIT", 1.0, 2, 7)] and r.n_licenses == 1


def test_bands_guarantee():
    assert (1 - 0.3) ** bands_for(0.3, 1, 0.001) <= 0.001 < (1 - 0.3) ** (bands_for(0.3, 1, 0.001) - 1)
    assert bands_for(1.0) == 1


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_synthetic_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id: r.licenses for r in scan_licenses(docs).collect()} == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_usual_notices(spark):
    rows = [("MIT", "This project is licensed under the MIT License - see LICENSE"), ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("GPL-2.0", "under the GNU General Public License version 2 only"), ("GPL-3.0", TEMPLATES["GPL-3.0"][1]), ("BSD-2-Clause", "licensed under the BSD 2-clause license"), ("EPL-2.0", "under the terms of the Eclipse Public License 2.0"), ("CC0-1.0", "Creative Commons CC0 1.0 Universal"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"), ("CC-BY-4.0", TEMPLATES["CC-BY-4.0"][0])]
    df = spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string")
    assert [r.licenses for r in scan_licenses(df).orderBy("doc_id").collect()] == [n for n, _ in rows]
