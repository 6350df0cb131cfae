"""URL filters: rules first, and gradient-boosted trees on lexical features.

The trees are fitted in numpy on a sample of at most ``FIT_ROWS`` labelled urls
(those with the smallest hashes), and applied to all urls by the tasks. Labels:
in the query, the verdicts of the rules on the urls they cover.

Defined results: null urls, and urls without ``://``, have an empty host and path,
and are judged by the trees like any other; of rules that fit, the longest wins
(ties: the first by text); without labels of both kinds all unlabelled urls are
allowed; an empty table gives an empty result; extra columns are ignored;
repeated rows are judged each by itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.shared import smallest

#: (verdict, host and path)
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS, L2 = 80, 4, 0.15, 32, 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    chosen = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # the last that fits wins
        top, slash, rest = rule.partition("/")
        fits = ((host == top) | F.endswith(host, F.lit("." + top))) & F.startswith(path, F.lit(slash + rest))
        chosen, verdict = F.when(fits, rule).otherwise(chosen), F.when(fits, kind).otherwise(verdict)
    return chosen, verdict


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


FEATURES = ["length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy",
            "parameters", "fragment", "hyphens", "secure", "longest_label", "extension", "suffix_rate", "suffix_2_rate", "first_segment_rate"]


def parts(url: str) -> tuple[str, str, str]:
    """The statistics' keys: last host label, last two, first path segment."""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0].lower()
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), re.match(r"/?([^/?#]*)", rest[len(host):])[1]


def lexical(url: str | None) -> list[float]:
    url = url or ""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    query = rest[len(host) + len(path):].partition("#")[0]
    digits = lambda t: sum(c.isdigit() for c in t) / max(1, len(t))
    return [len(url), len(host), len(path), host.count(".") + 1, sum(map(bool, path.split("/"))), digits(url), digits(host), entropy(url),
            entropy(host), sum(map(bool, query.lstrip("?").split("&"))), "#" in rest, url.count("-"), url.startswith("https://"),
            max(map(len, host.split("."))), "." in path.rsplit("/", 1)[-1]]


class Model:
    """Boosted trees for the log-odds of a block."""

    def __init__(self, urls: list[str | None], labels: np.ndarray):
        self.prior = float(np.clip(labels.mean(), 0.01, 0.99))
        self.rates = []
        for k in range(3):  # suffix statistics, smoothed
            n, hit = Counter(), Counter()
            for u, y in zip(urls, labels):
                part = parts(u or "")[k]
                n[part] += 1
                hit[part] += int(y)
            self.rates.append({p: (hit[p] + 5 * self.prior) / (n[p] + 5) for p in n if n[p] >= 5})
        x = self.features(urls)
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self.bin(x)
        score = np.full(len(x), math.log(self.prior / (1 - self.prior)))
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(binned, labels - p, p * (1 - p))
            self.trees.append(tree)
            score += self.run(tree, binned)

    def features(self, urls: list[str | None]) -> np.ndarray:
        rows = [lexical(u) + [r.get(p, self.prior) for r, p in zip(self.rates, parts(u or ""))] for u in urls]
        return np.array(rows, np.float64).reshape(len(urls), len(FEATURES))

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, col, "left") for c, col in zip(self.cuts, x.T)], 1).astype(np.uint8)

    @staticmethod
    def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete tree: feature and bin of each inner node, value of each leaf."""
        feature, cut = np.zeros(2 ** DEPTH - 1, np.int64), np.full(2 ** DEPTH - 1, 255, np.int64)
        at = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            base, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                cell = (at - base) * BINS + x[:, f]
                g = np.bincount(cell, grad, width * BINS).reshape(width, BINS).cumsum(1)
                h = np.bincount(cell, hess, width * BINS).reshape(width, BINS).cumsum(1)
                gain = lambda a, b: a * a / (b + L2)
                gains = gain(g, h) + gain(g[:, -1:] - g, h[:, -1:] - h) - gain(g[:, -1:], h[:, -1:])
                k = gains.argmax(1)
                top = gains[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                feature[base:base + width][better], cut[base:base + width][better] = f, k[better]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        leaf = at - (2 ** DEPTH - 1)
        value = RATE * np.bincount(leaf, grad, 2 ** DEPTH) / (np.bincount(leaf, hess, 2 ** DEPTH) + L2)
        return feature, cut, value

    @staticmethod
    def run(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        return value[at - (2 ** DEPTH - 1)]

    def predict(self, urls: list[str | None]) -> np.ndarray:
        x = self.bin(self.features(urls))
        score = reduce(np.add, (self.run(t, x) for t in self.trees), np.full(len(x), math.log(self.prior / (1 - self.prior))))
        return 1 / (1 + np.exp(-score))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model from ``labelled`` (url, label 0 or 1), of which at most
    ``fit_rows`` urls are taken; None if these are not of both kinds."""
    rows = smallest(labelled.where("label IS NOT NULL"), F.xxhash64("url", "label"), fit_rows, "url", "label").collect()
    y = np.array([r["label"] for r in rows], np.float64)
    return Model([r["url"] for r in rows], y) if 0 < y.sum() < len(y) else None


def score(df: DataFrame, model: Model | None, url: str = "url", out: str = "block_score") -> DataFrame:
    """``df`` with the probability of a block; 0 without a model."""
    if model is None:
        return df.withColumn(out, F.lit(0.0))
    df = df.drop(out)
    at, names = df.columns.index(url), [*df.columns, out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = pa.array(model.predict(batch.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, p], names=names)

    return df.mapInArrow(run, schema)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every page."""
    host, path = split_url(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumns({"rule": rule, "by_rule": verdict})
    model = fit(rows.where("rule IS NOT NULL").select("url", (F.col("by_rule") == "block").cast("int").alias("label")), fit_rows)
    judged = score(rows, model)
    learned = F.when(F.col("block_score") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", learned).alias("verdict"), "block_score")
