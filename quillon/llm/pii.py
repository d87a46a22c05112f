"""Personal data by candidate gradient boosting.

Base patterns with their checks give spans that always stay. High-recall generators propose further, overlapping
spans: local phone numbers, obfuscated addresses, national ids, account numbers, secrets. Boosted
trees score each proposal from its format and the words around it, Platt scaling makes the scores
probabilities, and for each generator a threshold with the wanted precision on held-out examples selects what is
redacted. The trees are trained on examples written by a generator below, from a fixed seed.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blobs import bounded


KINDS = ["email", "ip", "card", "phone", "account", "national_id", "secret"]
_ORDER = {k: i for i, k in enumerate(KINDS)}
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern that pass its check, by start, then kind."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:  # a match is an @ with all the local characters before it that no match has taken
        low = at
        while low > done and text[low - 1] in _LOCAL:
            low -= 1
        m = _DOMAIN.match(text, at + 1) if low < at else None
        if m:
            out.append((low, m.end(), "email"))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


#: name: (kind, what must occur in a text at all, pattern)
GENERATORS: dict[str, tuple[str, str, re.Pattern]] = {
    "local_phone": ("phone", "", re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])")),
    "digit_run": ("account", "", re.compile(r"(?<![0-9A-Za-z.,-])[0-9]{8,19}(?![0-9A-Za-z])")),
    "national": ("national_id", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    "iban": ("account", "", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    "ipv6": ("ip", ":", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    "key": ("secret", "", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")),
    "spelled_mail": ("email", "dot", re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64}\x20?[(\[]?\x20?at\x20?[)\]]?\x20?[A-Za-z0-9-]{1,40}(?:\x20?[(\[]?\x20?dot\x20?[)\]]?\x20?[A-Za-z]{2,12})+")),
}
_NAMES = list(GENERATORS)
_WORDS = {
    "contact": ("call", "phone", "tel", "mobile", "fax", "dial", "contact", "reach", "text me", "whatsapp"),
    "mail": ("mail", "write", "contact", "reach"),
    "secret": ("token", "key", "secret", "password", "passwd", "auth", "bearer", "credential"),
    "identity": ("ssn", "social", "security", "passport", "national id", "tax", "taxpayer"),
    "bank": ("account", "iban", "bank", "transfer", "card", "routing", "deposit"),
    "host": ("server", "host", "address", "ip", "connect", "ping", "from"),
    "other": ("isbn", "order", "version", "commit", "page", "pages", "figure", "date", "part", "model", "sha", "checksum", "hash", "range", "item", "year", "id="),
}
_CONTEXT = {k: re.compile("|".join(rf"(?<![a-z]){re.escape(w)}" for w in ws)) for k, ws in _WORDS.items()}
WIDTH = 32


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator) of all generators; spans may overlap."""
    out = []
    for i, name in enumerate(_NAMES):
        _, needs, pattern = GENERATORS[name]
        if needs in text:
            out += [(m.start(), m.end(), i) for m in pattern.finditer(text) if name != "key" or _DIGIT.search(text, m.start(), m.end())]
    return out


def describe(text: str, start: int, end: int, generator: int) -> list[float]:
    """Format and context features of a proposal."""
    s = text[start:end]
    left, right = text[max(0, start - WIDTH) : start].lower(), text[end : end + WIDTH].lower()
    counts, n = Counter(s), len(s)
    digits = sum(c.isdigit() for c in s)
    upper, lower = sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    number = _NOT_DIGIT.sub("", s)
    groups = re.split(r"[^0-9A-Za-z]+", s.strip("()"))
    return [
        *(float(generator == i) for i in range(len(_NAMES))),
        n, digits, upper, lower, n - digits - upper - lower, len(groups), max(map(len, groups)), len(groups[-1]),
        -sum(c / n * math.log2(c / n) for c in counts.values()), len(counts),
        float(bool(re.fullmatch("[0-9a-f]+", s))), float(len(number) >= 12 and luhn(number)), float(_mod97(s)), float(s[0] == "("), float(number[:2] in ("19", "20")),
        *(float(bool(p.search(left))) for p in _CONTEXT.values()), *(float(bool(p.search(right))) for p in _CONTEXT.values()),
        float(left.rstrip()[-1:] in ("=", ":")), float(left[-1:] in "\"'" and bool(left)), float(right[:1] in "\"'" and bool(right)), float("/" in left[-1:] + right[:1]),
    ]


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{8,32}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Texts with their true spans: personal data in its usual surroundings, and look-alikes without any."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-") for _ in range(k))
    word = lambda: "".join(r.choice(["en", "th", "er", "on", "re", "an", "st", "li", "ou", "ta"]) for _ in range(r.choice([1, 2, 3])))

    def iban() -> str:
        country, account = r.choice(["DE", "FR", "ES", "GB", "NL"]), d(r.choice([14, 18, 20]))
        check = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
        s = f"{country}{check:02d}{account}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    local = lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(4)} {d(3)} {d(3)}", f"0{d(2)}/{d(3)} {d(4)}"])
    good = [
        (local, "phone", ["call me at {}", "phone: {}", "tel {}", "mobile {}", "fax: {}", "reach us on {}", "contact {}", "text me {}", "dial {}"]),
        (lambda: f"{d(3)}-{d(2)}-{d(4)}", "national_id", ["ssn {}", "social security number {}", "my SSN is {}", "taxpayer id {}", "{}"]),
        (iban, "account", ["iban {}", "transfer to {}", "account: {}", "{}"]),
        (lambda: d(r.choice([8, 9, 10, 12])), "account", ["account number {}", "bank account: {}", "routing {}", "deposit to account {}"]),
        (lambda: r.choice([hexa(32), hexa(40), hexa(64), hexa(256), mixed(24), mixed(40), mixed(r.choice([100, 250, 500]))]), "secret", ['token = "{}"', "api_key={}", "secret: {}", "password: {}", "Authorization: Bearer {}", 'key = "{}"', "auth token {}"]),
        (lambda: ":".join(hexa(4) for _ in range(8)), "ip", ["server {}", "host {}", "connect to {}", "ping {}", "{}"]),
        (lambda: f"{word()}.{word()} at {word()} dot {r.choice(['com', 'org', 'net'])}", "email", ["mail {}", "write to {}", "contact {}", "reach {}", "{}"]),
        (lambda: f"{word()}{d(2)} [at] {word()} [dot] com", "email", ["mail {}", "{}"]),
    ]
    bad = [
        (local, ["part {}", "order {}", "item {}", "model {}", "range {}", "pages {}"]),
        (lambda: f"{d(3)} {d(3)} {d(4)}", ["{}", "range {}", "figure {}"]),
        (lambda: f"{r.choice(['19', '20'])}{d(2)} {d(3)} {d(4)}", ["{}", "year {}"]),
        (lambda: f"{r.choice(['19', '20'])}{d(2)}-{r.choice(['01', '12'])}-{d(2)}", ["date {}", "{}"]),
        (lambda: f"{d(3)}-{d(2)}-{d(4)}", ["part {}", "isbn {}", "model {}"]),
        (lambda: d(r.choice([8, 9, 10, 13, 16])), ["isbn {}", "order {}", "item {}", "{}", "id={}", "page {}", "version {}"]),
        (lambda: r.choice([hexa(40), hexa(64), hexa(32), hexa(256)]), ["commit {}", "sha {}", "checksum {}", "hash {}", "/{}/"]),
        (lambda: "-".join(word() for _ in range(8)) + d(1), ["{}", "page {}", "/{}"]),
        (lambda: f"{r.choice(['AB', 'QX'])}{d(2)} {d(4)} {d(4)}", ["part {}", "model {}", "{}"]),
        (lambda: ":".join(d(2) for _ in range(4)), ["version {}", "date {}", "{}"]),
        (lambda: f"{word()} at {word()} dot {word()}", ["{}", "figure {}"]),
    ]
    out = []
    for _ in range(n):
        before, after = (" ".join(word() for _ in range(r.choice([0, 3, 8]))) for _ in range(2))
        if r.random() < 0.5:
            make, kind, frames = r.choice(good)
        else:
            (make, frames), kind = r.choice(bad), None
        value, frame = make(), r.choice(frames)
        head = f"{before} {frame.split('{}')[0]}" if before else frame.split("{}")[0]
        out.append((f"{head}{value}{frame.split('{}')[1]} {after}", [(len(head), len(head) + len(value), kind)] if kind else []))
    return out


@dataclass
class Boosted:
    """Trees of depth 3 boosted on logistic loss, over features cut into at most 32 bins."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    prior: float = 0.0
    nodes: list[list[tuple[int, float]]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.prior = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.prior)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at, nodes = np.zeros(len(y), int), []
            for level in range(self.depth):
                following = np.zeros(len(y), int)
                for node in range(2**level):
                    inside = at == node
                    f, cut = self._best(binned[inside], g[inside], h[inside], cuts)
                    nodes.append((f, cut))
                    following[inside] = 2 * node + (x[inside, f] > cut)
                at = following
            leaf = np.bincount(at, g, 2**self.depth) / (np.bincount(at, h, 2**self.depth) + 1)
            self.nodes.append(nodes)
            self.leaves.append(self.rate * leaf)
            score += self.leaves[-1][at]
        return self

    @staticmethod
    def _best(binned: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
        best, found = 0.0, (0, math.inf)
        total_g, total_h = g.sum(), h.sum()
        for f, c in enumerate(cuts):
            if not len(c) or not len(g):
                continue
            left_g = np.cumsum(np.bincount(binned[:, f], g, len(c) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[:, f], h, len(c) + 1))[:-1]
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            k = int(gain.argmax())
            if gain[k] > best + 1e-9:
                best, found = float(gain[k]), (f, float(c[k]))
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for nodes, leaf in zip(self.nodes, self.leaves, strict=True):
            at = np.zeros(len(x), int)
            for level in range(self.depth):
                first = 2**level - 1
                f = np.array([nodes[first + i][0] for i in range(2**level)])[at]
                cut = np.array([nodes[first + i][1] for i in range(2**level)])[at]
                at = 2 * at + (x[np.arange(len(x)), f] > cut)
            out += leaf[at]
        return out


@dataclass
class Model:
    trees: Boosted
    slope: float
    shift: float
    thresholds: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.score(x) + self.shift)))

    def redact(self, x: np.ndarray, generator: np.ndarray) -> np.ndarray:
        return self.probability(x) >= self.thresholds[generator]


def labelled(cases: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, truth and generator of every proposal in the examples. A proposal is right if it is a true span of its kind."""
    x, y, g = [], [], []
    for text, true in cases:
        for a, b, i in proposals(text):
            x.append(describe(text, a, b, i))
            y.append(any(a == s and b == e and GENERATORS[_NAMES[i]][0] == k for s, e, k in true))
            g.append(i)
    return np.array(x, float), np.array(y, float), np.array(g, int)


@functools.cache
def train(n: int = 6000, seed: int = 11, precision: float = 0.95) -> Model:
    """Trees on the first half of the examples; scaling and thresholds on the second, which they haven't seen."""
    x, y, _ = labelled(examples(n // 2, seed))
    trees = Boosted().fit(x, y)
    x, y, g = labelled(examples(n - n // 2, seed + 1))
    s, slope, shift = trees.score(x), 1.0, 0.0
    for _ in range(50):  # Newton steps on the logistic loss of slope * s + shift
        p = 1 / (1 + np.exp(-(slope * s + shift)))
        w, e = p * (1 - p) + 1e-9, y - p
        a, b, c = (w * s * s).sum() + 1e-3, (w * s).sum(), w.sum() + 1e-3
        u, v = (e * s).sum(), e.sum()
        det = a * c - b * b
        slope, shift = slope + (c * u - b * v) / det, shift + (a * v - b * u) / det
    model = Model(trees, slope, shift, np.full(len(_NAMES), 2.0))
    p = model.probability(x)
    for i in range(len(_NAMES)):
        order = np.argsort(-p[g == i])
        right = np.cumsum(y[g == i][order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(right >= precision)
        if len(enough):
            model.thresholds[i] = max(0.5, p[g == i][order][enough[-1]])
    return model


def spans(text: str, model: Model, base: list[Span] | None = None) -> list[Span]:
    """Base spans, and the selected proposals that overlap neither them nor a likelier one; by start, then kind. A secret
    may have base spans inside it, such as a run of its digits that passes for a card."""
    base = base_spans(text) if base is None else base
    found = proposals(text)
    if not found:
        return base
    starts, ends = [], []  # of disjoint taken runs, sorted
    for a, b, _ in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    x = np.array([describe(text, *c) for c in found], float)
    g = np.array([c[2] for c in found])
    p = model.probability(x)
    chosen = [(-p[i], *found[i]) for i in np.flatnonzero(p >= model.thresholds[g])]
    out, taken = list(base), [True] * len(starts)  # of runs: base or not
    for _, a, b, i in sorted(chosen):
        i_at = bisect.bisect_left(starts, b)  # runs before it start before b
        first, kind = i_at, GENERATORS[_NAMES[i]][0]
        while first and ends[first - 1] > a:
            first -= 1
        over = range(first, i_at)
        if not over or kind == "secret" and all(taken[k] and a <= starts[k] and ends[k] <= b and (a, b) != (starts[k], ends[k]) for k in over):
            starts[first:i_at], ends[first:i_at], taken[first:i_at] = [a], [b], [False]
            out.append((a, b, kind))
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def listed(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span as its kind in brackets; spans that overlap go as one, under the first one's kind."""
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _find(model: Model, texts: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(source):
            counts, digests, every, sizes, clean = {k: [] for k in KINDS[:4]}, [], [], [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                n = Counter(k for _, _, k in base)
                for k in counts:
                    counts[k].append(n[k])
                found = spans(text, model, base)
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                every.append(listed(found))
                sizes.append(len(found))
                if texts:
                    clean.append(redacted(text, found))
            columns = [b.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in counts), pa.array(digests, pa.string()), pa.array(every, pa.string()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(clean, pa.string())] * texts, ["doc_id", *(f"n_{k}" for k in counts), "base_sha256", "spans", "n_spans"] + ["redacted"] * texts)

    return run


def find_personal_data(docs: DataFrame, texts: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans (how many spans, of any kind), and with
    ``texts`` also redacted, the text without them.

    Spans are kind:start:end in code points, end exclusive. Null and empty texts have none. Rows that repeat
    a doc_id, and rows with a null one, each give a row. Further columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long" + ", redacted string" * texts
    return docs.mapInArrow(_find(train(), texts), schema)
