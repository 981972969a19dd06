import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from formline.llm import packing
from tests.llm.helpers import corpus, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def odd():
    texts, _ = corpus(80)
    rng = random.Random(1)
    long = " ".join(rng.choice(texts) for _ in range(600))
    return [*texts, None, "", " \n", "~ a~b x ~ y^", "a\x1cb c", "<|endoftext|> foo<|startoftext|>bar", "café ́x İstanbul ΣΑΣ", "x" * 9000 + " y", "日本語 テスト 🎉🎉 don't I'll", "a b c\x85d​e", long, long, *texts[:20]]


def test_ids_are_the_tokenizers():
    e = packing.Encoder(PATH)
    texts = [t or "" for t in odd()]
    for _ in range(2):  # with an empty memo, and with a full one
        assert [x.tolist() for x in e(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 3, 60, 900])
def test_plan(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(rng.lognormal(6, 1.6, n).astype(int) + 1, 40_000)
    out = packing.plan(lengths)
    for key, at in (("item", "start"), ("sequence", "offset")):
        for _, g in out.sort_values([key, at]).groupby(key):
            assert g[at].tolist() == [0, *g["length"].cumsum()[:-1]]
    assert out.groupby("item")["length"].sum().reindex(range(n), fill_value=0).tolist() == lengths.tolist()
    used = out.groupby("sequence")["length"].sum()
    assert ((used == 4096) | (used & (used - 1) == 0)).all()


def test_least_squares_uses_up_a_histogram():
    hist = np.zeros(64)
    hist[[31, 15, 47]] = 10, 6, 6  # halves, and a quarter with three quarters
    a = packing.combinations(64)
    assert (a.T @ np.arange(1, 65) == 64).all()
    assert np.abs(a @ packing.nnls(64, hist) - hist).max() < 0.05


def test_round_trip(spark):
    texts = odd()
    docs = documents(spark, texts, start=5, item="x", sequence_id="y")
    got = packing.pack(docs, shard_chars=60_000).toPandas()
    tok = packing.Encoder(PATH).tokenizer
    for i, g in got.sort_values(["doc_id", "start"]).groupby("doc_id"):
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (g["doc_tokens"] == len(ids)).all() and g["length"].sum() == len(ids)
        at = 0
        for r in g.itertuples():
            assert r.start == at
            at += r.length
            assert zlib.crc32(np.array(ids[r.start : at], dtype="<u4").tobytes()) == r.ids_crc32
    assert got["doc_id"].nunique() == len(texts)
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 4096


def test_repeated_nameless_and_no_rows(spark):
    docs = documents(spark, ["a b", "c"])
    both = docs.unionByName(docs).selectExpr("nullif(doc_id, 0) AS doc_id", "text")
    got = packing.pack(both).toPandas()
    assert got["length"].sum() == 10 and got["doc_id"].isna().sum() > 0
    assert packing.pack(docs.limit(0)).count() == 0


def pieces_of(rows):
    """The pieces by document in order, each document's number of ids, and whether they tile documents and sequences."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for key, groups in (("start", by_doc), ("offset", by_seq)):
        for g in groups.values():
            g.sort(key=lambda r: r[key])
            at = 0
            for r in g:
                assert r[key] == at
                at += r["length"]
    used = [sum(r["length"] for r in g) for g in by_seq.values()]
    assert max(used) <= 4096
    return by_doc, used


def test_query_packs_all_ids_of_whole_texts(spark, small):
    e = packing.Encoder(PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    by_doc, used = pieces_of(packing.op1_packing(spark, small).collect())
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = np.array([*e.tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        assert {r["doc_tokens"] for r in by_doc[i]} == {len(ids)} and sum(r["length"] for r in by_doc[i]) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in by_doc[i])
    padded = sum(0 if n & (n - 1) == 0 else 4096 - n for n in used)
    assert padded <= 0.01 * sum(used)


def test_rows_without_ids_and_equal_rows_spread_over_shards(spark):
    docs = documents(spark, ["the same words in every row " * 40] * 600).withColumn("doc_id", F.lit(None).cast("long")).repartition(4)
    out = packing.pack(docs, shard_chars=60_000)
    shards = out.select((F.col("sequence_id") / F.lit(1 << 32)).cast("long").alias("s"), "length").groupBy("s").agg(F.sum("length").alias("n")).collect()
    assert len(shards) > 5 and max(r["n"] for r in shards) < 0.4 * sum(r["n"] for r in shards)
