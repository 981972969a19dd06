"""Toxicity: subword-bag embeddings, averaged into a linear softmax.

A word is the bag of its character n-grams, so that misspellings and unseen endings share vectors
with words that were learned. The embedding of a text is the average of its distinct words' bags, each
word weighted by exp(``SHARPNESS`` x its log odds), so that few words in a long text still count and
all words take part; a two-class linear softmax judges it. Vectors and softmax are trained jointly in
numpy on a bounded sample of labelled rows (``PER_CLASS`` of each label by a hash of ``doc_id``,
texts up to ``MAX_CHARS`` characters). Vectors start at their n-grams' log odds. A logistic
regression of a quarter of the sample, kept from the training, sets the level of scores by the
average and by the logarithm of the number of distinct words, so that scores do not drift with length.

Null, empty and wordless texts score as an average of 0 over no words. If one label is missing from
the sample, the score is that of no evidence, 0. A very long text is averaged whole, in one task. Rows are scored one by one; repeated rows agree, ties in the sample go by
hash and then ``doc_id``. A ``doc_id`` with both labels gives both to its text. An empty table gives
an empty one. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, not_held_out, table

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
#: How much more the toxic words of a text weigh in its average; at 0 all weigh alike.
SHARPNESS = 2.0
#: Imagined texts of the rarer label that hold a bucket.
PRIOR = 3.0
PER_CLASS = {1: 1000, 0: 1500}
MAX_CHARS = 12_000
ROUNDS = 12
CUT = 0.7
WORD = re.compile(r"[^\W\d_]+")
MEMO_WORDS = 300_000


def words_of(text: str) -> list[str]:
    """The distinct words, as they come."""
    return list(dict.fromkeys(WORD.findall(text.lower())))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every character n-gram of ``<word>``, and of the whole word."""
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    chars = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    ends = np.cumsum(sizes)
    out_w, out_b = [], []
    code = np.zeros(len(chars), dtype=np.uint64)
    prime, spread = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, max(GRAMS) + 1):
        if len(chars) < n:
            break
        code = code[: len(chars) - n + 1] * prime + chars[n - 1 :]
        if n in GRAMS:
            ok = rows[: len(code)] == rows[n - 1 :]
            out_w.append(rows[: len(code)][ok])
            out_b.append((code[ok] * spread) >> np.uint64(64 - 17))
    # The whole word, as the sum of its places' codes.
    place = np.arange(len(chars), dtype=np.uint64) - np.repeat((ends - sizes).astype(np.uint64), sizes)
    each = (chars + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * spread
    whole = np.add.reduceat(each ^ (each >> np.uint64(29)), ends - sizes) if len(words) else np.zeros(0, dtype=np.uint64)
    out_w.append(np.arange(len(words), dtype=np.int64))
    out_b.append((whole * spread) >> np.uint64(64 - 17))
    return np.concatenate(out_w), np.concatenate(out_b).astype(np.int64)


@dataclass
class Model:
    #: What a bucket's vector adds to the log odds; the softmax is linear, so the vectors fold into it.
    odds: np.ndarray
    #: Of the average, of the logarithm of the number of words, and the intercept.
    levels: tuple[float, float, float]

    def words(self, words: list[str]) -> np.ndarray:
        """Mean log odds of each word's bag."""
        w, b = subwords(words)
        return np.bincount(w, self.odds[b], len(words)) / np.maximum(np.bincount(w, minlength=len(words)), 1)

    def score(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts whose words' log odds lie end to end."""
        slope, length, start = self.levels
        mean = np.bincount(np.repeat(np.arange(len(sizes)), sizes), attention(values, sizes) * values, len(sizes))
        return 1 / (1 + np.exp(-np.clip(slope * mean + length * np.log1p(sizes) + start, -40, 40)))


def attention(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each word's weight in the average of its text, by its log odds; a text's weights add up to one."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    top = np.full(len(sizes), -np.inf)
    np.maximum.at(top, row, values)
    each = np.exp(SHARPNESS * (values - top[row]))
    return each / np.bincount(row, each, len(sizes))[row]


def fit(texts: list[str], labels: np.ndarray, check: int = 4) -> Model | None:
    """None unless both labels occur. Every ``check``-th text of a label is kept from the training, to set score levels by."""
    if len(set(labels.tolist())) < 2:
        return None
    nth = np.zeros(len(labels), dtype=np.int64)
    for x in (0, 1):
        nth[labels == x] = np.arange((labels == x).sum())
    apart = nth % check == check - 1
    if min((apart & (labels == x)).sum() for x in (0, 1)) < 3:
        return train(texts, labels)
    model = train([t for t, a in zip(texts, apart, strict=True) if not a], labels[~apart])
    words = [words_of(t) for t, a in zip(texts, apart, strict=True) if a]
    values, sizes = model.words([w for ws in words for w in ws]), np.array([len(ws) for ws in words])
    mean = np.bincount(np.repeat(np.arange(len(sizes)), sizes), attention(values, sizes) * values, len(sizes))
    model.levels = levels(np.stack([mean, np.log1p(sizes)], axis=1), labels[apart].astype(float))
    return model


def levels(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, ...]:
    """Slopes and intercept of a logistic regression with a little ridge; labels weigh alike."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    beta = np.zeros(x.shape[1])
    pull = np.array([1e-3] * (x.shape[1] - 1) + [1e-5])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + pull * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return (max(float(beta[0]), 1e-3), *map(float, beta[1:]))


def train(texts: list[str], labels: np.ndarray, seed: int = 0, rounds: int = ROUNDS) -> Model:
    """Vectors and classifier together; with no rounds, the start alone."""
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], dtype=np.int64) for t in texts]
    w_of, b_of = subwords(list(vocab))
    sizes, flat = np.array([len(d) for d in docs]), np.concatenate(docs)
    row = np.repeat(np.arange(len(docs)), sizes)
    y, n = labels.astype(float), len(vocab)
    count = np.bincount(w_of, minlength=n)
    # Document frequencies of buckets by label, for the start; smoothed so that a bucket that no text has says nothing.
    by_word = np.split(b_of[np.argsort(w_of, kind="stable")], np.cumsum(count)[:-1])
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, words in enumerate(docs):
        if len(words):
            (pos if y[i] else neg)[np.unique(np.concatenate([by_word[w] for w in words]))] += 1
    ratio = (1 - y).sum() / y.sum()
    vectors = np.random.default_rng(seed).normal(0, 0.05, (BUCKETS, DIM))
    vectors[:, 0] = np.log((pos + PRIOR) * ratio / (neg + PRIOR * ratio))
    soft = np.zeros((DIM, 2))  # columns: not toxic, toxic
    soft[0] = (-1, 1)
    bias = np.array([1.5, -1.5])
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    sq_v, sq_s, sq_b = np.full(BUCKETS, 1e-6), 1e-6, 1e-6
    for _ in range(rounds):
        bags = np.stack([np.bincount(w_of, vectors[b_of, k], n) for k in range(DIM)], axis=1) / np.maximum(count, 1)[:, None]
        share = attention((bags @ (soft[:, 1] - soft[:, 0]))[flat], sizes)
        mean = np.stack([np.bincount(row, share * bags[flat, k], len(docs)) for k in range(DIM)], axis=1)
        logit = mean @ soft + bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        err = (p - np.stack([1 - y, y], axis=1)) * weight[:, None]
        g_soft, g_bias, g_mean = mean.T @ err / len(y), err.mean(axis=0), err @ soft.T
        g_bag = np.stack([np.bincount(flat, share * g_mean[row, k], n) for k in range(DIM)], axis=1) / np.maximum(count, 1)[:, None]
        g_v = np.stack([np.bincount(b_of, g_bag[w_of, k], BUCKETS) for k in range(DIM)], axis=1)
        sq_v = sq_v + (g_v**2).mean(axis=1)
        sq_s, sq_b = sq_s + (g_soft**2).mean(), sq_b + (g_bias**2).mean()
        vectors -= 0.3 * g_v / np.sqrt(sq_v)[:, None]
        soft -= 0.05 * g_soft / sq_s**0.5
        bias -= 0.2 * g_bias / sq_b**0.5
    return Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), (1.0, 0.0, float(bias[1] - bias[0])))


def sample(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None, max_chars: int = MAX_CHARS) -> tuple[list[str], np.ndarray]:
    """Labelled rows outside the held-out fold, at most ``per_class`` of each label."""
    per_class = per_class or PER_CLASS
    marks = labels.where(F.col("toxic").isin(0, 1) & not_held_out(F.col("doc_id"), 3, 1)).select("doc_id", "toxic").distinct()
    rows = docs.where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    known = rows.select("doc_id").join(marks, "doc_id")
    # Each task keeps its own first rows, so no task sees a whole label.
    parts = [known.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for x, n in per_class.items()]
    ids = reduce(DataFrame.unionByName, parts).distinct()
    got = rows.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic").distinct().orderBy("toxic", F.xxhash64("text")).collect()
    return [r["text"] for r in got], np.array([r["toxic"] for r in got], dtype=np.int64)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        memo: dict[str, float] = {}
        for pdf in bounded(batches, chars=1_000_000):
            if m is None:
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "score": np.zeros(len(pdf))})
                continue
            found = [words_of(t) for t in pdf["text"]]
            new = list({w for ws in found for w in ws if w not in memo})
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = list({w for ws in found for w in ws})
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                memo.update(zip(part, m.words(part).tolist(), strict=True))
            values = np.fromiter((memo[w] for ws in found for w in ws), dtype=float)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "score": m.score(values, np.array([len(ws) for ws in found], dtype=np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(*sample(docs, table(spark, sf_dir, "labels"))))
    held = F.coalesce(~not_held_out(F.col("doc_id"), 3, 1), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
