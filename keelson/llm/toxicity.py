"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

Character n-grams (3 to 5 bytes, with the word's ends) of lower-cased words are
hashed to embeddings; the mean over the n-grams of a stretch of ``STRETCH`` running words
goes through a linear softmax. Misspelt words share most n-grams with the words
they come from. A document is as toxic as its most toxic stretch, wherever it stands, so a
few words in a long text are not diluted. As the softmax is linear, embeddings and
weights fold into one number per n-gram for scoring.

The model is fitted on at most ``FIT_TOXIC`` + ``FIT_CLEAN`` labelled documents
(those whose ids have the smallest hashes), and applied to all documents, whole.

Defined results: null, empty and wordless texts get the score of the least toxic
text of the sample; a doc_id with several labels is toxic if one says so; null labels are
ignored; without labels of both kinds all scores are 0; repeated rows are scored
each by itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.shared import smallest

FIT_TOXIC, FIT_CLEAN = 1500, 3000
BUCKETS, DIM, SIZES = 1 << 18, 8, (3, 4, 5)
#: STRETCH and HEAD_START have the best F1 at the threshold in threefold cross-validation over the labelled documents that
#: may be learned from; held-out ones had no part in it.
STRETCH, STEP = 2, 1
EPOCHS, STEPS, RATE, SEED = 6, 300, 0.5, 7
HEAD_START = 8.0
THRESHOLD = 0.3

#: Lower-cases A-Z and turns all other ASCII but digits and a-z into spaces.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, word) of each n-gram of the words of a text, and the number of words."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not ws:
        return np.empty(0, np.int32), np.empty(0, np.int32), 0
    b = np.frombuffer(b" " + b" ".join(ws) + b" ", np.uint8)
    space = b == 32
    word = np.cumsum(space) - 1  # of the character, and of the space before it
    spaces = np.concatenate([[0], np.cumsum(space)])
    buckets, words = [], []
    h = b.astype(np.uint32)
    for size in range(2, max(SIZES) + 1):
        h = h[:len(b) - size + 1] * np.uint32(0x01000193) ^ b[size - 1:]
        if size in SIZES:
            n = len(h)
            inside = spaces[size - 1:size - 1 + n] - spaces[1:1 + n]  # no space but at the ends
            at = np.flatnonzero(inside == 0)
            x = h[at] * np.uint32(0x9E3779B1)
            buckets.append((x >> np.uint32(14)).astype(np.int32))
            words.append(word[at + 1].astype(np.int32))  # the second character is never a space
    return np.concatenate(buckets), np.concatenate(words), len(ws)


def stretches(n_words: int) -> np.ndarray:
    """Where stretches begin; the last ends with the text."""
    last = max(0, n_words - STRETCH)
    return np.unique(np.append(np.arange(0, last + 1, STEP), last))


def stretch_logits(table: np.ndarray, text: str | None) -> np.ndarray:
    """The mean of the n-grams' numbers in each stretch."""
    bucket, word, n = grams(text)
    if not n:
        return np.full(1, -np.inf)
    total = np.concatenate([[0], np.cumsum(np.bincount(word, table[bucket], n))])
    count = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])
    a = stretches(n)
    z = np.minimum(a + STRETCH, n)
    return (total[z] - total[a]) / np.maximum(count[z] - count[a], 1)


class Model:
    """Embeddings and softmax, and what the scores need of them."""

    def __init__(self, texts: list[str | None], labels: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.embeddings = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.softmax = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.square = np.full((BUCKETS, 1), 1e-6, np.float32)
        self.docs = [grams(t) for t in texts]  # 4-byte numbers: 25 kB for a text of 3 kB
        self.clean = np.full(BUCKETS, -1.0)  # occurrences in clean documents; -1: in none at all
        for (bucket, _, _), y in zip(self.docs, labels):
            self.clean[bucket] = np.maximum(self.clean[bucket], 0)
            if not y:
                np.add.at(self.clean, bucket, 1)
        fold = rng.random(len(texts)) < 0.8
        start = self.surprise(np.flatnonzero(fold), labels)
        self.embeddings[:, 0] += (HEAD_START * np.sign(start) * np.maximum(np.abs(start) - 1, 0)).astype(np.float32)
        self.softmax[0] = -0.5, 0.5
        epoch = steps = 0
        while epoch < EPOCHS or steps < STEPS:  # fewer documents, more epochs
            taken = self.epoch(np.flatnonzero(fold), labels, rng, epoch)
            if not taken:
                break
            epoch, steps = epoch + 1, steps + taken
        del self.square
        table = self.table()
        top = np.array([stretch_logits(table, t).max() for t in texts])
        self.least = float(top[np.isfinite(top)].min(initial=0.0))  # for texts without words
        top = np.maximum(top, self.least)
        self.scale, self.shift = self.calibrate(top[~fold], labels[~fold]) if len(set(labels[~fold])) == 2 else self.calibrate(top, labels)
        del self.docs
        self.numbers = self.table().astype(np.float64)
        del self.embeddings, self.softmax, self.clean

    def table(self) -> np.ndarray:
        """The log-odds of toxic that an n-gram stands for; n-grams that no
        document has count as the average one of clean documents."""
        odds = self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])
        return np.where(self.clean >= 0, odds, (odds * np.maximum(self.clean, 0)).sum() / max(1.0, self.clean[self.clean > 0].sum()))

    def surprise(self, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """How much oftener an n-gram is in toxic documents than its frequency
        lets expect, in standard deviations: where training starts."""
        toxic, all_ = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for d in rows:
            seen = np.unique(self.docs[d][0])
            all_[seen] += 1
            if labels[d]:
                toxic[seen] += 1
        expected = all_ * labels[rows].mean()
        return (toxic - expected) / np.sqrt(expected + 1)

    def epoch(self, rows: np.ndarray, labels: np.ndarray, rng: np.random.Generator, epoch: int) -> int:
        """Batches of stretches: of toxic documents the most toxic so far, of others
        the most toxic and some more. Returns their number."""
        table = self.table()
        bags, targets = [], []
        for d in rng.permutation(rows):
            bucket, word, n = self.docs[d]
            if not n:
                continue
            starts = stretches(n)
            total = np.concatenate([[0], np.cumsum(np.bincount(word, table[bucket], n))])
            count = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])
            z = np.minimum(starts + STRETCH, n)
            by_score = np.argsort(-(total[z] - total[starts]) / np.maximum(count[z] - count[starts], 1), kind="stable")
            if labels[d]:
                pick = by_score[:2]
            else:
                pick = np.unique(np.append(by_score[:1], rng.choice(len(starts), min(3, len(starts)), False)))
            for s in starts[pick]:
                bags.append(bucket[(word >= s) & (word < s + STRETCH)])
                targets.append(int(labels[d]))
        order = rng.permutation(len(bags))
        for k in range(0, len(order), 64):
            part = order[k:k + 64]
            self.step([bags[i] for i in part], np.array([targets[i] for i in part]))
        return -(-len(order) // 64)

    def step(self, bags: list[np.ndarray], y: np.ndarray) -> None:
        sizes = np.array([max(1, len(b)) for b in bags])
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        bucket = np.concatenate(bags)
        mean = np.stack([self.embeddings[b].sum(0) for b in bags]) / sizes[:, None]
        logits = mean @ self.softmax + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        back = (p @ self.softmax.T) / sizes[:, None]
        own, place = np.unique(bucket, return_inverse=True)
        grad = np.stack([np.bincount(place, back[bag, j], len(own)) for j in range(DIM)], 1).astype(np.float32)
        self.square[own] += (grad ** 2).mean(1, keepdims=True)
        self.softmax -= RATE * 0.02 * (mean.T @ p).astype(np.float32)
        self.bias -= RATE * 0.02 * p.sum(0).astype(np.float32)
        self.embeddings[own] -= RATE * grad / np.sqrt(self.square[own])

    @staticmethod
    def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Logistic regression of the label on the highest logit, by Newton steps with a weak prior."""
        center, spread = float(x.mean()), float(x.std()) or 1.0
        design = np.stack([(x - center) / spread, np.ones(len(x))], 1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ w))
            hess = design.T @ (design * (p * (1 - p))[:, None]) + np.eye(2) * 0.1
            w -= np.clip(np.linalg.solve(hess, design.T @ (p - y) + 0.1 * w), -2, 2)
        return float(w[0] / spread), float(w[1] - w[0] * center / spread)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        top = np.array([max(stretch_logits(self.numbers, t).max(), self.least) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.scale * top + self.shift, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> Model | None:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); None
    without labels of both kinds."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda kind, limit: smallest(marks.where(F.col("toxic") == kind), F.xxhash64("doc_id"), limit, "doc_id")
    chosen = first(1, fit_toxic).unionByName(first(0, fit_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])  # fit_toxic + fit_clean at most
    y = np.array([int(r["toxic"]) for r in rows])
    return Model([r["text"] for r in rows], y) if 0 < y.sum() < len(y) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.numbers.astype(np.float32), model.scale, model.shift, model.least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        m.numbers, m.scale, m.shift, m.least = shared.value
        for batch in batches:
            scores = m.predict([t.as_py() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def judge_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; held-out labels are not learned from."""
    held = lambda c: F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = fit(docs, labels.where(~held(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
