"""Personal data by a semi-Markov conditional random field.

Fixed patterns give the base spans. The field looks at the regions of a text that
hold digits or ``@``: it scores whole candidate segments of at most ``MAX_TOKENS``
tokens by features of the segment (digits, grouping, octets, borders; a card must have its checksum),
and dynamic programming chooses boundaries and kinds of a region together. It
finds what the patterns miss, such as a phone number and a card number side by
side. Base spans stay; spans of the field are added where they overlap none.

The weights are learned by likelihood in numpy, from the regions of at most
``FIT_DOCS`` documents (those whose ids have the smallest hashes) and at most
``FIT_REGIONS`` of these. Base spans are the labels, regions where a pattern
matched too many digits for one number are left out, and copies of labelled regions with
other notations of the same numbers are added.

Defined results: null and empty texts have no span; without a region to learn
from nothing is added; repeated rows are searched each by itself; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.shared import smallest

KINDS = ("email", "ip", "card", "phone")
FIT_DOCS, FIT_REGIONS = 8000, 1500
MAX_TOKENS, MAX_CHARS = 16, 64
EPOCHS, RATE, DECAY = 25, 0.2, 1e-3
MIN_MARGINAL = 0.6

_SEED = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: As the contract's patterns; the lookbehind and the possessive repeats only keep them linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small_octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the base spans, and the matches that failed by too many
    digits: they may hold more than one number."""
    good, failed = [], []
    at, used = text.find("@"), 0
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            good.append((start, 0, m.end()))
            used = m.end()
        at = text.find("@", max(at + 1, used))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            digits = "".join(_DIGITS.findall(m[0]))
            ok = (all(map(small_octet, m[0].split("."))) if kind == 1 else 12 <= len(digits) <= 19 and luhn(digits) if kind == 2
                  else 9 <= len(digits) <= 15)
            if ok:
                good.append((m.start(), kind, m.end()))
            elif kind > 1 and len(digits) > (19 if kind == 2 else 15):
                failed.append(m.span())
    return sorted(good), sorted(failed)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and ``@``, to the next space on either side."""
    out = []
    for m in _SEED.finditer(text):
        a, b = m.span()
        low, high = max(0, a - MAX_CHARS), min(len(text), b + MAX_CHARS)
        while a > low and not text[a - 1].isspace():
            a -= 1
        while b < high and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1] + 2:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FEATURES = 30
#: The place of the feature that says that a segment has the digits and the checksum of a card, and the kind it decides.
CHECKSUM, CARD = 14, 2


def segment_features(text: str, a: int, b: int) -> np.ndarray:
    s = text[a:b]
    groups = _DIGITS.findall(s)
    digits = "".join(groups)
    n = len(digits)
    local, _, domain = s.partition("@")
    before, after = text[a - 1:a], text[b:b + 1]
    nearer = text[b + 1:b + 2]
    lengths = [len(g) for g in groups]
    rest = re.sub(r"[0-9\x20().+-]", "", s)
    return np.array([
        1, s.count("@") == 1, bool(local) and _LOCAL.issuperset(local) and "@" in s, bool(_DOMAIN.fullmatch(domain)),
        bool(re.search(r"\.[A-Za-z]{2,}$", domain)), s.startswith("+"), s.startswith("("), n == 0, n <= 4, 5 <= n <= 8, 9 <= n <= 11,
        12 <= n <= 15, 16 <= n <= 19, n > 19, 12 <= n <= 19 and luhn(digits), len(groups) == 4 and bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", s)),
        bool(groups) and all(map(small_octet, groups)), not rest, rest == "" and "." not in s, s.isdigit(), lengths[-2:] == [3, 4],
        lengths == [4, 4, 4, 4], "(" in s and s.count("(") == s.count(")"), s.count("(") != s.count(")"), " " in s, "-" in s,
        before.isalnum() or before in ("+", "@", "."), after.isalnum() or after == "@", after in ("-", ".") and nearer.isalnum(),
        max(lengths, default=0) > 4 and len(groups) > 1], np.float64)


class Lattice:
    """The candidate segments of a region, by token borders."""

    def __init__(self, text: str, start: int, end: int):
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        self.borders = [start, *[b for _, b in tokens]]
        self.n = len(tokens)
        blank = [text[a].isspace() for a, _ in tokens]
        spans, rows = [], []
        for i in range(self.n):
            if blank[i]:
                continue
            for j in range(i + 1, min(self.n, i + MAX_TOKENS) + 1):
                a, b = tokens[i][0], tokens[j - 1][1]
                if b - a > MAX_CHARS:
                    break
                if not blank[j - 1] and b - a >= 5 and _SEED.search(text, a, b):
                    spans.append((i, j))
                    rows.append(segment_features(text, a, b))
        self.spans = spans
        self.x = np.array(rows, np.float64).reshape(len(rows), FEATURES)
        self.into = [[] for _ in range(self.n + 1)]
        for k, (_, j) in enumerate(spans):
            self.into[j].append(k)

    def scores(self, w: np.ndarray) -> np.ndarray:
        """Of each segment and kind; a segment without a card's checksum is no card."""
        s = self.x @ w
        s[self.x[:, CHECKSUM] == 0, CARD] = -np.inf
        return s

    def marginals(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Log of the sum over all segmentations; the probability of each (segment, kind)."""
        s = self.scores(w)
        top = s.max(1, initial=-np.inf) if len(s) else s
        total = top + np.log(np.exp(s - top[:, None]).sum(1)) if len(s) else np.zeros(0)
        ahead = np.full(self.n + 1, -np.inf)
        ahead[0] = 0
        for j in range(1, self.n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *[ahead[self.spans[k][0]] + total[k] for k in self.into[j]]])
        behind = np.full(self.n + 1, -np.inf)
        behind[self.n] = 0
        for j in range(self.n, 0, -1):
            behind[j - 1] = np.logaddexp(behind[j - 1], behind[j])
            for k in self.into[j]:
                i = self.spans[k][0]
                behind[i] = np.logaddexp(behind[i], behind[j] + total[k])
        at = np.array(self.spans, np.int64).reshape(-1, 2)
        p = np.exp(ahead[at[:, 0]][:, None] + s + behind[at[:, 1]][:, None] - ahead[-1])
        return float(ahead[-1]), p

    def best(self, w: np.ndarray) -> list[tuple[int, int]]:
        """(segment, kind) of the best segmentation, in order."""
        s = self.scores(w)
        score, came = [0.0], [None]
        for j in range(1, self.n + 1):
            options = [(score[j - 1], None)]
            for k in self.into[j]:
                kind = int(s[k].argmax())
                options.append((score[self.spans[k][0]] + s[k, kind], (k, kind)))
            top = max(options, key=lambda o: o[0])
            score.append(top[0])
            came.append(top[1])
        out, j = [], self.n
        while j:
            if came[j] is None:
                j -= 1
            else:
                out.append(came[j])
                j = self.spans[came[j][0]][0]
        return out[::-1]


def notations(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Copies of a region with other notations of its phone and card numbers."""
    def change(kind: int, s: str, how: int) -> str:
        d = "".join(_DIGITS.findall(s))
        if kind == 3:
            t = d[-10:]
            return [f"({t[:3]}) {t[3:6]}-{t[6:]}", f"{t[:3]}-{t[3:6]}-{t[6:]}", f"+{d[:-10]} {t[:3]}.{t[3:6]}.{t[6:]}"][how] if len(d) >= 10 else s
        if kind == 2:
            return (".", "/", "  ")[how].join(d[i:i + 4] for i in range(0, len(d), 4))
        return s

    out = []
    for how in range(3):
        new, moved, last = "", [], 0
        for a, kind, b in spans:
            new += text[last:a]
            piece = change(kind, text[a:b], how)
            moved.append((len(new), kind, len(new) + len(piece)))
            new, last = new + piece, b
        new += text[last:]
        if new != text:
            out.append((new, moved))
    return out


def meeting(spans: list[tuple], stretches: list[tuple[int, int]]) -> Iterator[list[tuple]]:
    """For each stretch, in order, the spans (start first, end last) that overlap it."""
    first = 0
    for a, b in stretches:
        while first < len(spans) and spans[first][-1] <= a:
            first += 1
        mine, k = [], first
        while k < len(spans) and spans[k][0] < b:
            if spans[k][-1] > a:
                mine.append(spans[k])
            k += 1
        yield mine


def examples(text: str) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled regions of a text, without those that may hold unlabelled numbers."""
    good, failed = base_spans(text)
    places = regions(text)
    for (a, b), mine, bad in zip(places, meeting(good, places), meeting(failed, places)):
        whole = all(a <= x and y <= b for x, _, y in mine) and all(p[2] <= q[0] for p, q in zip(mine, mine[1:]))
        if whole and b - a <= 400 and all(any(x <= s and e <= y for x, _, y in mine) for s, e in bad):
            yield text[a:b], [(x - a, k, y - a) for x, k, y in mine]


def learn(regions_: list[tuple[str, list[tuple[int, int, int]]]]) -> np.ndarray | None:
    """Weights (feature, kind) by gradient steps on the likelihood of the labels."""
    cases = []
    for text, spans in [*regions_, *[x for t, s in regions_ if s for x in notations(t, s)]]:
        lattice = Lattice(text, 0, len(text))
        index = {(lattice.borders[i], lattice.borders[j]): k for k, (i, j) in enumerate(lattice.spans)}
        truth = [(index.get((a, b)), kind) for a, kind, b in spans]
        if all(k is not None for k, _ in truth) and len(lattice.spans):
            cases.append((lattice, truth))
    if not any(truth for _, truth in cases):
        return None
    w, square = np.zeros((FEATURES, len(KINDS))), np.full((FEATURES, len(KINDS)), 1e-6)
    w[0] = -2.0
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(cases)), max(1, len(cases) // 32)):
            grad = -DECAY * len(part) * w
            for c in part:
                lattice, truth = cases[c]
                _, p = lattice.marginals(w)
                grad -= lattice.x.T @ p
                for k, kind in truth:
                    grad[:, kind] += lattice.x[k]
            square += grad ** 2
            w += RATE * grad / np.sqrt(square)
    return w


def added_spans(text: str, base: list[tuple[int, int, int]], w: np.ndarray) -> list[tuple[int, int, int]]:
    out, places = [], regions(text)
    for (a, b), mine in zip(places, meeting(base, places)):
        if len(mine) == 1 and mine[0][0] <= a + 1 and mine[0][2] >= b - 1:
            continue  # the base span is all there is
        lattice = Lattice(text, a, b)
        if not lattice.spans:
            continue
        chosen = lattice.best(w)
        if not chosen:
            continue
        p = lattice.marginals(w)[1]
        for seg, kind in chosen:
            x, y = lattice.borders[lattice.spans[seg][0]], lattice.borders[lattice.spans[seg][1]]
            if p[seg, kind] >= MIN_MARGINAL and all(y <= s or x >= e for s, _, e in mine):
                out.append((x, kind, y))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_regions: int = FIT_REGIONS) -> np.ndarray | None:
    ids = smallest(docs.where("doc_id IS NOT NULL").select("doc_id").distinct(), F.xxhash64("doc_id"), fit_docs, "doc_id")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"region": t, "spans": [{"a": a, "k": k, "b": b} for a, k, b in s]}
                     for text in batch.column(0) for t, s in examples(text.as_py() or "")]
            span = pa.list_(pa.struct([("a", pa.int32()), ("k", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("region", pa.string()), ("spans", span)]))

    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")  # fit_docs ids at most
    found = texts.mapInArrow(take, "region string, spans array<struct<a:int,k:int,b:int>>").distinct()
    rows = found.orderBy(F.xxhash64("region"), "region").limit(fit_regions).collect()
    return learn([(r["region"], [(x["a"], x["k"], x["b"]) for x in r["spans"]]) for r in rows])


def find(docs: DataFrame, w: np.ndarray | None) -> DataFrame:
    """doc_id, base and added (spans as kind:start:end, comma-joined) and the counts of base spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans, n = [], [], [[] for _ in KINDS]
            for text in batch.column(1):
                text = text.as_py() or ""
                good = base_spans(text)[0] if _SEED.search(text) else []
                more = added_spans(text, good, w) if w is not None else []
                base.append(written(good))
                spans.append(written([*good, *more]))
                for k, column in enumerate(n):
                    column.append(sum(g[1] == k for g in good))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in n], pa.array(base, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *counts, "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in counts)}, base string, spans string")


def find_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document."""
    found = find(docs, fit(docs))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
