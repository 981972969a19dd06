import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import mixing
from tests.llm.helpers import corpus, documents


@pytest.fixture(scope="module")
def docs(spark):
    texts, langs = corpus(300)
    return documents(spark, [*texts, None, "", " "], [*langs, None, "en", None], __x=1)


def totals(rows, rate):
    t, p = np.array([r["n_tokens"] for r in rows], dtype=float), np.array([r["posterior"] for r in rows])
    return (t * np.array([r[rate] for r in rows])) @ p


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_targets_are_met(docs, least):
    weights = {"de": 0.4, "en": 0.4, "fr": 0.2}
    rows = mixing.mix(docs, mixing.domains_of(docs), weights, least).collect()
    assert len(rows) == 303 and all(r["rate"] >= least for r in rows)
    got = totals(rows, "rate")
    if least == 0:
        assert np.abs(got / got.sum() - [0.4, 0.4, 0.2]).max() < 0.01
        assert abs(got.sum() / totals([{**r.asDict(), "one": 1} for r in rows], "one").sum() - 1) < 0.01
    else:
        assert np.abs(got / got.sum() - [0.4, 0.4, 0.2]).max() < 0.02
    copies = totals(rows, "copies")
    assert np.abs(copies / got - 1).max() < 0.15
    right = [r for r in rows if r["lang"] and r["text"] and r["text"].strip()]
    assert np.mean([r["domain"] == r["lang"] for r in right]) > 0.97


def test_the_fit_is_that_of_a_plain_projected_gradient(docs):
    """The same problem solved in numpy: same expected totals."""
    rows = mixing.mix(docs, mixing.domains_of(docs), {"de": 0.9, "en": 0.05, "fr": 0.05}).collect()
    t, p = np.array([r["n_tokens"] for r in rows], dtype=float), np.array([r["posterior"] for r in rows])
    have = t @ p
    goal = np.array([0.9, 0.05, 0.05]) * have.sum()
    rate = np.ones(len(t))
    for _ in range(4000):
        rate = np.maximum(0, rate - 0.3 * p @ ((t * rate @ p - goal) / have))
    assert np.abs(totals(rows, "rate") - (t * rate) @ p).max() < 0.01 * have.sum()


def test_repeats(docs):
    mixed = mixing.mix(docs, mixing.domains_of(docs), least=1.0)
    n = mixed.agg(F.sum("copies")).first()[0]
    out = mixing.repeat(mixed, docs.columns)
    assert out.columns == docs.columns and out.count() == n and out.select("doc_id").distinct().count() == 303
    twice = docs.limit(20).unionByName(docs.limit(20))
    pairs = mixing.mix(twice, mixing.domains_of(docs)).groupBy("doc_id").agg(F.count_distinct("copies").alias("n"), F.count("*").alias("m")).collect()
    assert all(r["n"] == 1 and r["m"] == 2 for r in pairs)


def test_without_labels_and_without_rows(spark, docs):
    plain = mixing.mix(docs, mixing.domains_of(docs).where("domain = 'none'")).collect()
    assert {(r["domain"], r["copies"]) for r in plain} == {("all", 1)}
    assert mixing.mix(docs.limit(0), mixing.domains_of(docs).limit(0)).count() == 0
    blank = documents(spark, [None, ""], [None, None])
    assert mixing.mix(blank, mixing.domains_of(blank)).count() == 2


def test_clashing_names_are_replaced(docs):
    out = mixing.mix(docs.withColumn("rate", F.lit("x")).withColumn("tokens", F.lit(7)).withColumn("row", F.lit("r")), mixing.domains_of(docs))
    assert len(set(out.columns)) == len(out.columns)
    rows = out.select("rate", "tokens", "row", "copies").collect()
    assert {(r["tokens"], r["row"]) for r in rows} == {(7, "r")} and all(isinstance(r["rate"], float) for r in rows)


def test_targets_out_of_reach_are_said(spark):
    """One domain in every document: no rates change the shares, and the fit ends and says so."""
    texts = ["water light " * 20, "wasser licht " * 20] * 20
    rows = documents(spark, texts, ["en", "de"] * 20)
    same = rows.where("lang = 'en'")
    with pytest.warns(UserWarning, match="meet the targets"):
        out = mixing.mix(same, mixing.domains_of(rows).withColumn("doc_id", F.col("doc_id") - F.col("doc_id") % 2), {"en": 0.1, "de": 0.9})
        assert out.count() == 20


def test_many_steps_are_those_of_one_replay(docs, monkeypatch):
    """Rates written down on the way agree with all steps taken from the start."""
    weights = {"de": 0.9, "en": 0.05, "fr": 0.05}
    monkeypatch.setattr(mixing, "WRITTEN", 1)
    a = mixing.mix(docs, mixing.domains_of(docs), weights).collect()
    monkeypatch.setattr(mixing, "WRITTEN", 500)
    b = {r["doc_id"]: r["rate"] for r in mixing.mix(docs, mixing.domains_of(docs), weights).collect()}
    assert all(abs(r["rate"] - b[r["doc_id"]]) < 1e-6 for r in a)


def test_the_classifier_knows_held_out_documents(spark):
    texts, langs = corpus(400, seed=17)
    model = mixing.fit_classifier(texts[:200], langs[:200])
    p = model.posteriors(*mixing.Features()(texts[200:]))
    assert np.mean([model.domains[i] == x for i, x in zip(p.argmax(axis=1), langs[200:], strict=True)]) > 0.97


def test_a_hot_domain_is_sampled_without_a_window_over_its_rows(spark):
    from formline.llm.common import least_hashed

    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("domain"))
    got = least_hashed(rows, "domain", 150)
    assert {r["domain"]: r["count"] for r in got.groupBy("domain").count().collect()} == {"hot": 150, "rare": 150}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62))
    first = rows.where("domain = 'hot'").orderBy(place).limit(150)
    assert first.exceptAll(got).count() == 0


def test_query(spark, small):
    rows = mixing.op2_mixing(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    plain = {r["doc_id"]: r for r in mixing.mix(docs, mixing.domains_of(docs)).collect()}
    assert all((r["n_tokens"], r["domain"], r["copies"]) == tuple(plain[r["doc_id"]][c] for c in ("n_tokens", "domain", "copies")) for r in rows)
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
