"""Every stage of the pipeline against a plain version of what it does."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from formline.llm import quality
from tests.llm.helpers import corpus, documents
from tests.llm.test_dups import least, shingles, similar
from tests.llm.test_native import deduped, measured

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    texts, langs = corpus(90, seed=21)
    lines = [f"A line that many documents share, number {i}." for i in range(5)]
    texts = [t + "\n" + rng.choice(lines) + "\n" + " ".join(rng.choice(texts).split()[:25]) for t in texts]
    for t in texts[:15]:
        w = t.split(" ")
        w[3] = "other"
        texts.append(" ".join(w))
        langs.append("en")
    texts += [*texts[:5], None, "", "too short", "%%% $$$ " * 30]
    langs += [None] * 9
    return documents(spark, texts, langs, rate=1, kept_text="k", failed_bits="f", class_id=0).repartition(3).cache()


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]


def test_quality(spark, docs):
    out = STAGES["quality"](spark, docs, "")
    assert out.columns == docs.columns
    assert out.exceptAll(docs).count() == 0
    clean = {i for i, t in texts_of(docs).items() if (m := measured(t))[0] >= 20 and 100 * m[4] <= 30 * m[0] and 5 * m[2] <= m[0]}
    assert set(texts_of(out)) == clean
    assert quality.POLICIES["v1"] & quality.POLICIES["base"] == quality.POLICIES["base"]


def test_line_dedup(spark, docs):
    out = STAGES["line_dedup"](spark, docs, "")
    texts = texts_of(docs)
    order = sorted(texts)
    plain = deduped([texts[i] for i in order])
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert texts_of(out) == {i: plain[i][0] for i in order if plain[i][0].strip(" \t\n\x0b\x0c\r")}
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0 and out.where("kept_text <> 'k' or class_id <> 0").count() == 0


def test_near_dedup(spark, docs):
    out = STAGES["near_dedup"](spark, docs, "")
    sets = {i: shingles(t) for i, t in texts_of(docs).items()}
    links = [(i, j) for i in sets for j in sets if i < j and similar(sets[i], sets[j]) >= 0.8]
    assert set(texts_of(out)) == set(least(sets, links).values())
    assert out.columns == docs.columns and out.exceptAll(docs).count() == 0


def test_near_dedup_of_repeated_and_null_ids(spark):
    """One row of each group stays, and no text goes because another shares its id."""
    texts, _ = corpus(12, seed=5)
    texts = [" ".join(t.split() * 2 + [f"end{i}"]) for i, t in enumerate(texts)]
    a, b, c, d, e, f, g = texts[:7]
    near = a + " more"
    rows = [(7, a), (7, a), (3, near), (None, b), (None, b), (5, c), (None, c), (7, d), (None, e), (9, f), (9, g), (2, f), (7, a)]
    docs = spark.createDataFrame([(i, t, "en", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, row int").repartition(3)
    out = STAGES["near_dedup"](spark, docs, "")
    assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
    kept = sorted(((r["doc_id"] or -1, r["text"]) for r in out.collect()))
    assert kept == sorted([(3, near), (-1, b), (5, c), (7, d), (-1, e), (2, f), (9, g)])


def test_mixing(spark, docs):
    out = STAGES["mixing"](spark, docs, "")
    assert out.columns == docs.columns and set(texts_of(out)) == set(texts_of(docs))
    assert out.exceptAll(docs).count() == out.count() - docs.count() > 0


def test_packing(spark, docs):
    """Every row's ids are in the pieces once, and pieces tile sequences."""
    from formline.llm import packing
    from tests.llm.test_packing import PATH, pieces_of

    rows = docs.where("doc_id is not null")
    by_doc, _ = pieces_of(STAGES["packing"](spark, rows, "").collect())
    e = packing.Encoder(PATH)
    assert {i: g[0]["doc_tokens"] for i, g in by_doc.items()} == {i: len(e.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts_of(rows).items()}
    assert all(sum(r["length"] for r in g) == g[0]["doc_tokens"] for g in by_doc.values())


def test_mixing_meets_its_targets(spark, docs):
    """Copies follow the rates that a plain projected gradient finds for the stage's own posteriors."""
    import numpy as np

    from formline.llm import mixing

    mixed = mixing.mix(docs.drop("rate"), mixing.domains_of(docs), least=1.0).collect()
    t, p = np.array([r["n_tokens"] for r in mixed], dtype=float), np.array([r["posterior"] for r in mixed])
    have = t @ p
    share = (have / have.sum()) ** mixing.TEMPER
    goal = share / share.sum() / min(np.linalg.solve((p * t[:, None]).T @ p, share / share.sum()))
    rate = np.ones(len(t))
    for _ in range(3000):
        rate = np.maximum(1, rate - 0.3 * p @ ((t * rate @ p - goal) / have))
    assert np.abs(t * np.array([r["rate"] for r in mixed]) @ p - t * rate @ p).max() < 0.01 * goal.sum()
    out = STAGES["mixing"](spark, docs, "")
    copies = {r["doc_id"]: r["copies"] for r in mixed}
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == copies


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert corpus_pipeline.ORACLE_SQL is None
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    known = {r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} < known
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_empty(spark, docs, name):
    assert STAGES[name](spark, docs.limit(0), "").count() == 0
