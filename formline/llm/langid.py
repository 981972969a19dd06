"""Language identification: string kernels, Nyström landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts blends, over n of 1 to 3, the shared share of their letter n-grams:
|G_n(x) & G_n(y)| / sqrt(|G_n(x)| |G_n(y)|), presence and not counts, over the n-grams that some
landmark has. Every letter of a landmark counts as itself. A bounded sample of labelled rows is learned from: ``PER_LANGUAGE`` rows of each
language, by a hash of ``doc_id``, texts of up to ``MAX_CHARS`` characters. Scoring reads whole
texts in blocks: a block's presence matrix times the landmarks' gives the kernel, and that times
the regression's weights gives a score per language.

Text that is null or has no letter is ``und`` with score 0, as is everything if no row is labelled;
digits and other numerals are no letters. A very long text is one row of a block's matrix. Ties go to the language that sorts first. Rows are judged one by one, so repeated rows agree. An
empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, least_hashed, not_held_out, table

ORDERS = (1, 2, 3)
PER_LANGUAGE = 250
LANDMARKS = 24
MAX_CHARS = 20_000
#: Codes of n-grams are looked up in a table of up to so many, else by search.
TABLE = 1 << 22
RIDGE = 1e-2
BLOCK = 128
_MAYBE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _MAYBE.finditer(text))


@dataclass
class Model:
    languages: list[str]
    letters: np.ndarray  # letter class of each code point, 0: no letter
    grams: list[np.ndarray]  # by order: the sorted codes of the landmarks' n-grams
    tables: list[np.ndarray | None]  # by order: place of a code among them, or -1; none where that would be large
    landmarks: list[np.ndarray]  # by order: n-grams x landmarks, presence
    weights: np.ndarray  # landmarks x languages
    base: int

    def kernel(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.landmarks[0].shape[1]))
        for grams, places, marks, (rows, codes) in zip(self.grams, self.tables, self.landmarks, _codes(texts, self.letters, self.base), strict=True):
            at = _places(grams, codes) if places is None else places[codes]
            known = at >= 0
            seen = np.zeros((len(texts), marks.shape[0]), dtype=np.float32)
            seen[rows[known], at[known]] = 1
            # Products of presences are whole numbers, so they do not hang on a text's place in the block.
            out += (seen @ marks) / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True, dtype=np.float64), 1) * np.maximum(marks.sum(axis=0, keepdims=True, dtype=np.float64), 1))
        return out / len(ORDERS)

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.round(self.kernel(texts) @ self.weights, 9)


def _places(grams: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(grams):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
    return np.where(grams[at] == codes, at, -1)


def _codes(texts: list[str], letters: np.ndarray, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (text, code) of every n-gram that starts inside a text; what is no letter counts as a space."""
    low = [t.lower() + "  " for t in texts]
    sizes = np.array([len(t) for t in low], dtype=np.int64)
    chars = letters[np.minimum(np.frombuffer("".join(low).encode("utf-32-le", "replace"), dtype=np.uint32), len(letters) - 1)].astype(kind := np.int32 if base ** len(ORDERS) < 2**31 else np.int64)
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    code = np.zeros(len(chars), dtype=kind)
    for n in ORDERS:
        code = code[: len(chars) - n + 1] * base + chars[n - 1 :]
        # A gram of spaces alone says nothing, and the first letter must lie inside the text.
        ok = (code > 0) & (rows[: len(code)] == rows[n - 1 :])
        yield rows[: len(code)][ok], code[ok]


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """None if there is nothing to learn from."""
    languages = sorted(set(labels))
    if not languages:
        return None
    marks: list[str] = []
    for lang in languages:
        own = sorted((t for t, x in zip(texts, labels, strict=True) if x == lang), key=lambda t: abs(len(t) - 1500))
        marks += own[:LANDMARKS]
    seen: dict[str, int] = {}
    for t in marks:
        for c in set(t.lower()):
            if c.isalpha():
                seen[c] = seen.get(c, 0) + 1
    base = len(seen) + 2
    letters = np.zeros(0x110001, dtype=np.min_scalar_type(base))
    for i, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c))):
        letters[ord(c)] = i + 2
    # Letters that no landmark has are one class of their own.
    other = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    letters[:0x110000][other & (letters[:0x110000] == 0)] = 1
    grams, tables, planes = [], [], []
    for n, (rows, codes) in zip(ORDERS, _codes(marks, letters, base), strict=True):
        known = np.unique(codes)
        places = None
        if base**n <= TABLE:
            places = np.full(base**n, -1, dtype=np.int32)
            places[known] = np.arange(len(known), dtype=np.int32)
        plane = np.zeros((len(known), len(marks)), dtype=np.float32)
        plane[_places(known, codes), rows] = 1
        grams.append(known)
        tables.append(places)
        planes.append(plane)
    model = Model(languages, letters, grams, tables, planes, np.zeros((len(marks), len(languages))), base)
    k_nm = np.concatenate([model.kernel(texts[i : i + BLOCK]) for i in range(0, len(texts), BLOCK)]).astype(float)
    values, vectors = np.linalg.eigh(model.kernel(marks).astype(float))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k_nm @ root
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Rows of a rare language weigh as much together as those of a common one.
    weight = 1 / np.array([labels.count(x) for x in labels])
    gram = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1])
    model.weights = root @ np.linalg.solve(gram, (phi * weight[:, None]).T @ y)
    return model


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> tuple[list[str], list[str]]:
    """Labelled rows outside the held-out fold: at most ``per_language`` of each language."""
    rows = docs.where(not_held_out(F.col("doc_id"), 5, 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= max_chars))
    got = least_hashed(rows.select("doc_id", "lang", "text"), "lang", per_language).select("lang", "text").distinct().orderBy("lang", F.xxhash64("text"), "text").collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; score is the softmax of the winning margin."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in bounded(batches):
            for i in range(0, len(pdf), BLOCK):
                part = pdf.iloc[i : i + BLOCK]
                texts = [t or "" for t in part["text"]]
                pred, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
                ok = np.array([m is not None and has_letter(t) for t in texts], dtype=bool)
                if ok.any():
                    s = 4 * m.scores([t for t, x in zip(texts, ok, strict=True) if x])
                    p = np.exp(s - s.max(axis=1, keepdims=True))
                    pred[ok] = np.array(m.languages, dtype=object)[s.argmax(axis=1)]
                    score[ok] = p.max(axis=1) / p.sum(axis=1)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang_pred": pred, "score": score})

    # The fold stands in for nothing in the model: the function sees text alone, and the id passes by.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(*sample(docs)))
    return out.select("doc_id", F.coalesce(~not_held_out(F.col("doc_id"), 5, 0), F.lit(False)).alias("held_out"), "lang_pred", "score")
