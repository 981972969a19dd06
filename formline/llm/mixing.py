"""Mixing to target weights with soft membership of domains.

A softmax over hashed words, trained on a bounded sample of a labelled table, gives every document
its posterior over domains. Nonnegative rates are then fitted so that the expected tokens of each
domain, the sum of tokens x posterior x rate, meet their targets: least squares by projected
gradient. A step changes a rate by the document's posterior times a vector with one number per
domain, so the state of the fit is the list of those vectors; a pass takes the new ones for each
document and sums once per domain, and nothing but those sums reaches the driver. The fit goes on until
the targets are met or no step moves the sums any longer, and warns if they are not met. A rate
becomes that many copies, the fraction decided by a hash of ``doc_id`` and text. Documents go through
the classifier once; posteriors are written beside their rows.

Null, empty and wordless texts have no tokens, the same share of every domain, and the rate that
follows. Without labelled rows all documents are one domain. A domain with no expected tokens cannot
meet a target and is left out of it. Repeated rows get equal rates. Of domains with equal posteriors the
first by name is the document's. A very long text is one row of hashed words, read whole by one task. An
empty table gives an empty one. Other columns pass through unchanged, but for those named like one of
``ADDED``, which the operator's own replace.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Workspace, bounded, least_hashed, table

FEATURES = 1 << 15
PER_DOMAIN = 250
MAX_CHARS = 20_000
#: Target weights, where none are given, are shares to this power.
TEMPER = 0.7
#: Steps after which the rates so far are written down, so that the work of a fit follows its steps.
WRITTEN = 16
#: The fit ends when no domain misses its target by more than this share of all tokens.
TOLERANCE = 1e-4
#: It also ends when a step moves no domain's sum by more than this share of all tokens.
STILL = 2e-5
MEMO_WORDS = 300_000
#: Columns that the operator adds.
ADDED = ("n_tokens", "domain", "posterior", "rate", "copies")


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # features x domains, float32
    bias: np.ndarray

    def posteriors(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(sizes)), sizes)
        got = self.weights[features]
        s = np.stack([np.bincount(rows, got[:, k], len(sizes)) for k in range(len(self.domains))], axis=1)
        s = np.where(sizes[:, None] > 0, s / np.maximum(sizes, 1)[:, None] + self.bias, 0.0)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


class Features:
    """Hashed words of texts, with a memo."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        memo, out, sizes = self.memo, [], []
        for t in texts:
            words = WORD.findall(t.lower()) if any(c in t for c in "\x1c\x1d\x1e\x1f\x85\xa0") else t.lower().split()
            sizes.append(len(words))
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for w in set(words).difference(memo):
                memo[w] = zlib.crc32(w.strip(".,;:!?#*$%&|").encode("utf-8", "surrogatepass")) % FEATURES
            out += [memo[w] for w in words]
        return np.array(out, dtype=np.int64), np.array(sizes, dtype=np.int64)


def fit_classifier(texts: list[str], labels: list[str], rounds: int = 120) -> Classifier:
    """Softmax regression on mean word vectors, by gradient steps scaled per feature; domains weigh alike."""
    domains = sorted(set(labels)) or ["all"]
    k = len(domains)
    model = Classifier(domains, np.zeros((FEATURES, k), dtype=np.float32), np.zeros(k))
    if k < 2:
        return model
    feats, sizes = Features()(texts)
    rows = np.repeat(np.arange(len(texts)), sizes)
    part = 1 / np.maximum(sizes, 1)[rows]
    y = np.array([domains.index(x) for x in labels])
    gold = np.eye(k)[y]
    share = 1 / np.bincount(y, minlength=k)[y] / k
    weights, seen = np.zeros((FEATURES, k)), np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        model.weights = weights
        err = (model.posteriors(feats, sizes) - gold) * share[:, None]
        grad = np.stack([np.bincount(feats, err[rows, j] * part, FEATURES) for j in range(k)], axis=1)
        seen += (grad**2).mean(axis=1)
        weights = weights - 1.5 * grad / np.sqrt(seen)[:, None]
    model.weights = weights.astype(np.float32)
    return model


def sample(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN, max_chars: int = MAX_CHARS) -> tuple[list[str], list[str]]:
    """Texts and domains of at most ``per_domain`` rows of each domain of ``labels`` (doc_id, domain)."""
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    known = labels.where("domain is not null").select("doc_id", F.col("domain").cast("string").alias("domain"))
    ids = least_hashed(known, "domain", per_domain)
    got = texts.join(F.broadcast(ids), "doc_id").select("text", "domain").distinct().orderBy("domain", F.xxhash64("text"), "text").collect()
    return [r["text"] for r in got], [r["domain"] for r in got]


def membership(model: Classifier, spark: SparkSession):
    """A function of text: struct of tokens (words) and posterior."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("tokens long, posterior array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        feats = Features()
        for texts in batches:
            out = [pd.DataFrame({"tokens": pd.Series(dtype="int64"), "posterior": pd.Series(dtype=object)})] if not len(texts) else []
            for pdf in bounded([pd.DataFrame({"text": texts.fillna("")})]):
                f, sizes = feats(list(pdf["text"]))
                out.append(pd.DataFrame({"tokens": sizes, "posterior": list(held.value.posteriors(f, sizes))}))
            yield pd.concat(out, ignore_index=True)

    return of


def rates(posterior: np.ndarray, rate: np.ndarray, steps: list[np.ndarray], least: float) -> np.ndarray:
    """Rates after the steps, projected to ``least`` or more after each."""
    for v in steps:
        rate = np.maximum(least, rate - np.einsum("ij,j->i", posterior, v))
    return rate


def _posteriors(column: pd.Series, k: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), k)


def sums(members: DataFrame, k: int, steps: list[np.ndarray], least: float, products: bool = False) -> np.ndarray:
    """Expected tokens of each domain after the steps; with ``products`` also the sums of tokens x posterior x posterior, below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1 if products else 1, k))
        for pdf in batches:
            if len(pdf):
                p, t = _posteriors(pdf["posterior"], k), pdf["tokens"].to_numpy(dtype=np.float64)
                total[0] += (t * rates(p, pdf["rate"].to_numpy(dtype=np.float64), steps, least)) @ p
                if products:
                    total[1:] += (p * t[:, None]).T @ p
        yield pd.DataFrame({"i": np.arange(total.size), "x": total.ravel()})

    got = members.select("tokens", "posterior", "rate").mapInPandas(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((k + 1 if products else 1) * k)
    for r in got:
        out[r["i"]] = r["x"]
    return out.reshape(-1, k)


def _stepped(members: DataFrame, k: int, steps: list[np.ndarray], least: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(rate=rates(_posteriors(pdf["posterior"], k), pdf["rate"].to_numpy(dtype=np.float64), steps, least))

    return members.mapInPandas(run, "tokens long, posterior array<double>, rate double")


@dataclass
class Mix:
    domains: list[str]
    targets: np.ndarray
    reached: np.ndarray
    steps: list[np.ndarray]

    @property
    def met(self) -> bool:
        return bool(np.abs(self.reached - self.targets).max(initial=0) <= TOLERANCE * self.targets.sum())


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float] | None, least: float, space: Workspace) -> Mix:
    """Rates of at least ``least`` whose expected tokens meet the targets; ``members`` has tokens and posterior."""
    k = len(domains)
    members = members.select("tokens", "posterior", F.lit(max(1.0, least)).alias("rate"))
    moments = sums(members, k, [], 0.0, products=True)
    have, gram = moments[0] / max(1.0, least), moments[1:]
    some = have > 0
    if not some.any():
        return Mix(domains, have, have, [])
    share = np.where(some, (have / have.sum()) ** TEMPER if weights is None else np.array([weights.get(d, 0.0) for d in domains]), 0.0)
    if not share.sum():
        share = have.copy()
    share = share / share.sum()
    total = have.sum()
    if least:
        # A lower bound of the rates asks for a total that leaves every domain room to stay, and room for what documents of
        # others add to it: rates of posterior x solution meet the shares, and none is below its least entry.
        at = np.flatnonzero(some)
        room = np.linalg.lstsq(gram[np.ix_(at, at)], share[at], rcond=None)[0]
        total = max(least / room) if (room > 0).all() else max(least * h / s for h, s in zip(have, share, strict=True) if s > 0)
    targets = share * total
    scale = np.where(some, 1 / np.where(some, have, 1), 0.0)  # each domain's error counts in its own size
    root = np.sqrt(scale)
    pace = 1 / np.linalg.eigvalsh(root[:, None] * gram * root[None, :]).max()
    steps, new = [], []
    now, written = have * max(1.0, least), None
    while True:
        miss = now - targets
        if np.abs(miss).max() <= TOLERANCE * targets.sum():
            break
        steps.append(pace * scale * miss)
        new.append(steps[-1])
        last, now = now, sums(members, k, new, least)[0]
        if np.abs(now - last).max() <= STILL * targets.sum():
            break
        if len(new) == WRITTEN:
            members, new, done = space.save(_stepped(members, k, new, least), "rates"), [], written
            written = members
            if done is not None:
                space.drop(done)
    found = Mix(domains, targets, now, steps)
    if not found.met:
        warnings.warn(f"no rates of {least} or more meet the targets: shares reached: {", ".join(f"{d} {x:.3f}" for d, x in zip(domains, now / now.sum(), strict=True))}", stacklevel=2)
    return found


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, least: float = 0.0, columns: list[str] | None = None) -> DataFrame:
    """``docs``, or the ``columns`` of it that are named, with those of ``ADDED``."""
    spark = docs.sparkSession
    space = Workspace(spark, "mixing")
    model = fit_classifier(*sample(docs, labels))
    of = membership(model, spark)
    text = F.coalesce("text", F.lit(""))
    kept = [c for c in (docs.columns if columns is None else columns) if c not in ADDED]
    row = F.struct(*kept) if kept else F.lit(None).cast("boolean")
    part = F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 30)) / float(1 << 30)
    members = space.save(docs.select(row.alias("row"), part.alias("part"), of(text).alias("m")).select("row", "part", "m.tokens", "m.posterior"), "members")
    found = fit_rates(members, model.domains, weights, least, space)
    held, k, start = spark.sparkContext.broadcast(found.steps), len(model.domains), max(1.0, least)

    @F.pandas_udf("double")
    def rate_of(posterior: pd.Series) -> pd.Series:
        return pd.Series(rates(_posteriors(posterior, k), np.full(len(posterior), start), held.value, least))

    names = F.array(*[F.lit(d) for d in model.domains])
    p = F.col("posterior")
    return members.withColumn("rate", rate_of(p)).select(
        *[F.col("row")[c].alias(c) for c in kept],
        F.col("tokens").alias("n_tokens"),
        F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1).alias("domain"),
        p,
        "rate",
        F.floor(F.col("rate") + F.col("part")).alias("copies"),
    )


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as ``copies`` says."""
    return mixed.where("copies > 0").withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*columns)


def domains_of(docs: DataFrame) -> DataFrame:
    """The labelled table of the tests' data: languages as domains."""
    return docs.select("doc_id", F.col("lang").alias("domain"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = mix(docs, domains_of(docs), columns=["doc_id"])
    return out.select("doc_id", "n_tokens", "domain", F.array_max("posterior").alias("share"), "rate", "copies")
