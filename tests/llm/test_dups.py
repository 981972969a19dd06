"""Near-duplicates of documents and of embeddings, and components, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import embdedup, neardup
from formline.llm.common import Workspace
from formline.llm.components import least_members
from tests.llm.helpers import corpus, documents
from tests.oracle import check


def least(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    edges += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(80)] + edges[:5]
    ids = {x for e in edges for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["least"] for r in least_members(df, Workspace(spark, "test")).collect()}
    expected = least(ids, edges)
    assert {i: got.get(i, i) for i in ids} == expected
    assert least_members(df.limit(0), Workspace(spark, "test")).count() == 0


def shingles(text):
    w = (text or "").lower().split()
    out = {}
    for i in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[i : i + 5])
        out[s] = out.get(s, 0) + 1
    return out


def similar(a, b):
    """The definition, term by term."""
    both = a.keys() & b.keys()
    if not both:
        return 0.0
    x, y = ({k: 1 + np.log(v) / 8 for k, v in d.items()} for d in (a, b))
    union = a.keys() | b.keys()
    weighted = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in union) for i in both)
    return max(len(both) / len(union), weighted)


def near_texts():
    rng = random.Random(5)
    texts, _ = corpus(60, seed=11)
    texts = [" ".join(rng.choice(texts).split()[:30] + t.split()) for t in texts]
    out = list(texts)
    for t in texts[:25]:
        for _ in range(rng.randint(1, 4)):
            w = t.split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    chain = texts[40].split() * 3
    for i in range(0, 60, 2):  # each like the last, the ends unlike
        chain = [*chain[2:], f"new{i}", f"word{i}"]
        out.append(" ".join(chain))
    out += [texts[0].upper(), texts[1].replace(" ", "\n"), texts[2], texts[2], "few words", "Few  words", "one", None, "", " ", None]
    out += [("again and again and once more " * 40) + t for t in texts[:6]]
    return out + ["y " * 30_000, "y " * 30_001]


def test_near_duplicates(spark):
    texts = near_texts()
    order = list(range(len(texts)))
    random.Random(0).shuffle(order)
    texts = [texts[i] for i in order]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if similar(sets[i], sets[j]) >= 0.8]
    docs = documents(spark, texts, h1="x", keys=1, class_id="c").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got == least(range(len(texts)), links)


def test_blocks_of_a_mixed_bucket(spark, monkeypatch):
    """Buckets that hold several classes, cut into small blocks, lose no link."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "bands", lambda s: np.zeros((len(s), 1), dtype=np.int64))
    texts = [t for t in near_texts() if t and len(t) < 2_000][:70]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if similar(sets[i], sets[j]) >= 0.8]
    # The keys are computed on workers, which do not see the patch: make the single bucket here.
    real = neardup.sketches
    monkeypatch.setattr(neardup, "sketches", lambda d: real(d).withColumn("keys", F.when(F.col("keys").isNotNull(), F.array(F.lit(1).cast("long")))))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents(spark, texts)).collect()}
    assert got == least(range(len(texts)), links)


def test_query_is_the_definition(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(i, j) for i, j in combinations(sorted(sets), 2) if sets[i] and sets[j] and 0.3 < len(sets[i]) / len(sets[j]) < 3.4 and similar(sets[i], sets[j]) >= 0.8]
    rows = neardup.op5_neardup(spark, small).collect()
    comp = least(sorted(sets), links)
    assert {r["doc_id"]: (r["class_id"], r["kept"]) for r in rows} == {i: (c, c == i) for i, c in comp.items()}


@pytest.mark.parametrize("rate,least_recall,most_recall", [(0.0, 1.0, 1.0), (0.01, 0.95, 1.0), (0.02, 0.4, 0.9), (0.03, 0.0, 0.2)])
def test_near_copies_by_rate_of_edits(spark, rate, least_recall, most_recall):
    """Each copy is caught if it is above the threshold: nearly all with a word in a hundred changed, few with three in a hundred."""
    rng = random.Random(int(rate * 1000))
    texts, _ = corpus(60, seed=41)
    texts = [" ".join(rng.choice(texts).split() + t.split() + rng.choice(texts).split() * 3) + f" {i} {rng.random()}" for i, t in enumerate(texts)]
    words = [" ".join(f"{w}{rng.randint(0, 9)}" for w in t.split() * 3) for t in texts]
    copies = [" ".join("changed" if rng.random() < rate else w for w in t.split()) for t in words]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents(spark, words + copies)).collect()}
    n = len(words)
    caught = [got[i] == got[n + i] for i in range(n)]
    assert caught == [similar(shingles(a), shingles(b)) >= 0.8 for a, b in zip(words, copies, strict=True)]
    assert least_recall <= np.mean(caught) <= most_recall
    assert len({got[i] for i in range(n)}) == n


def test_the_bitmap_lets_every_wanted_id_through(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"))
    ids = rows.where("doc_id % 7 = 0")
    got = neardup.might_hold(ids, rows, bits=1 << 20)
    assert ids.join(got, "doc_id", "left_anti").count() == 0 and got.count() < 1.1 * ids.count()
    assert neardup.might_hold(ids, rows, bits=1 << 10).count() >= ids.count()  # a full bitmap tells nothing, and loses nothing
    assert neardup.might_hold(ids.limit(0), rows).count() == 0


def test_near_duplicate_edges(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "x"])
    twice = docs.unionByName(docs)
    assert {(r["doc_id"], r["class_id"]) for r in neardup.classes(twice).collect()} == {(0, 0), (1, 0), (2, 2)}
    nameless = docs.withColumn("doc_id", F.expr("nullif(doc_id, 0)"))
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in neardup.classes(nameless).collect())[1:] == [(1, 1), (2, 2)]
    assert neardup.classes(docs.limit(0)).count() == 0


def test_sketches_estimate_the_probability_jaccard():
    rng = np.random.default_rng(0)
    codes = rng.integers(1, 2**63, 400).astype(np.uint64)
    a, b = np.sort(codes[:300]), np.sort(codes[60:])
    na, nb = rng.integers(1, 9, len(a)), rng.integers(1, 9, len(b))
    agree = []
    for salt in range(40):
        x, y = (neardup.mix64(c ^ np.uint64(salt)) for c in (a, b))
        s = [neardup.sketch(np.zeros(len(c), dtype=np.int64), c, neardup.weights(n), 1) for c, n in ((x, na), (y, nb))]
        agree.append((s[0] == s[1]).mean())
    x, y = dict(zip(a.tolist(), neardup.weights(na))), dict(zip(b.tolist(), neardup.weights(nb)))
    union = x.keys() | y.keys()
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in union) for i in x.keys() & y.keys())
    assert abs(np.mean(agree) - exact) < 0.02


def test_sets_alike_with_unlike_repeats_meet_in_a_band():
    """A plain Jaccard of 0.8 meets in a band, also where weights make it 0.69."""
    rng = np.random.default_rng(9)
    n, shared, own = 1_500, 80, 10
    codes = rng.integers(1, 2**63, (n, shared + 2 * own)).astype(np.uint64)
    doc = np.repeat(np.arange(n), shared + own)
    count = np.tile(np.r_[np.ones(shared, dtype=np.int64), np.full(own, 500)], n)
    a, b = codes[:, : shared + own], np.concatenate([codes[:, :shared], codes[:, shared + own :]], axis=1)
    apart = [not np.isin(x, y).any() for x, y in zip(*(neardup.band_keys(doc, c.ravel(), count, n) for c in (a, b)), strict=True)]
    weighted = [neardup.bands(neardup.sketch(doc, c.ravel(), neardup.weights(count), n)) for c in (a, b)]
    assert (~(weighted[0] == weighted[1]).any(axis=1)).sum() > 5  # by weights alone
    assert sum(apart) == 0


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(90, 12))
    out = [v.tolist() for v in base]
    for v in base[:20]:
        out += [(v + rng.normal(size=12) * s).tolist() for s in (0.02, 0.1, 0.2, 0.3)]
    out += [base[0].tolist()] * 12 + [(base[1] * 7).tolist(), (-base[2]).tolist()]
    out += [None, [0.0] * 12, [1.0] * 11, [], [float("nan")] * 12, [float("inf"), *[1.0] * 11], [None, *[1.0] * 11], [1e-300] * 12, [1e300] * 12]
    return out


@pytest.mark.parametrize("tile_rows", [7, 64, 4096])
def test_embeddings(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(embdedup, "TILE_ROWS", tile_rows)
    all_ = vectors()
    unit = {}
    for i, v in enumerate(all_):
        if v and len(v) == 12 and None not in v and np.isfinite(v).all() and np.any(v):
            v = np.array(v) / np.abs(v).max()
            unit[i] = v / np.linalg.norm(v)
    links = [(i, j) for i, j in combinations(unit, 2) if unit[i] @ unit[j] >= 0.95]
    rows = spark.createDataFrame(list(enumerate(all_)), "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("n_links", F.lit("x"))
    found = embdedup.linked(rows.repartition(4), tile_rows=tile_rows)
    monkeypatch.setattr(embdedup, "linked", lambda *a, **k: found)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.classes(rows).collect()}
    comp = least(range(len(all_)), links)
    n = {i: 0 for i in comp}
    for i, j in links:
        n[i] += 1
        n[j] += 1
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in comp}


def test_embeddings_of_mixed_lengths(spark):
    """Each length is compared by itself, and an id with vectors of two lengths joins their components."""
    rng = np.random.default_rng(4)
    rows = []
    for d, n in ((3, 2), (8, 5), (5, 4), (1, 3)):
        v = rng.normal(size=d)
        rows += [(len(rows) + i, (abs(v) * (i + 1)).tolist()) for i in range(n)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    expected = {}
    for ids in (range(0, 2), range(2, 7), range(7, 11), range(11, 14)):
        expected |= {i: (len(ids) - 1, ids[0], i == ids[0]) for i in ids}
    assert got == expected
    both = spark.createDataFrame([*rows, (9, rows[3][1])], "vec_id long, embedding array<double>")
    assert {r["component_id"] for r in embdedup.classes(both).where("vec_id between 2 and 10").collect()} == {2}


def test_embeddings_edges(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert {(r["vec_id"], r["component_id"]) for r in embdedup.classes(rows).collect()} == {(0, 0), (1, 0)}
    assert embdedup.classes(rows.limit(0)).count() == 0
    assert [r["n_links"] for r in embdedup.classes(rows.where("vec_id = 1")).collect()] == [0]


def test_vectors_without_ids_link_with_nothing(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.01]), (None, [1.0, 0.0]), (6, [0.0, 1.0]), (5, None)], "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embdedup.classes(rows).collect()), key=str)
    assert got == sorted([(None, 0, None, True)] * 2 + [(5, 0, 5, True)] * 2 + [(6, 0, 6, True)], key=str)
    assert {(r["n_links"], r["kept"]) for r in embdedup.classes(rows.where("vec_id is null")).collect()} == {(0, True)}


def test_boxes_leave_out_no_link(spark, monkeypatch):
    """Clusters far apart are cut into leaves of their own; fewer pairs are compared, and none with a link is lost."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    v = np.concatenate([c + 0.12 * rng.normal(size=(60, 8)) for c in centres]).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    links = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.95, 1)))]
    kept = []
    real = embdedup.near_leaves
    monkeypatch.setattr(embdedup, "near_leaves", lambda boxes, r: kept.append((len(boxes), len(out := real(boxes, r)))) or out)
    rows = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.linked(rows, tile_rows=30).collect()}
    comp, n = least(range(len(v)), links), np.bincount(np.array(links).ravel(), minlength=len(v))
    assert got == {i: (n[i], comp[i]) for i in comp if n[i]}
    leaves, pairs = kept[0]
    assert leaves >= 16 and pairs < 0.7 * leaves * (leaves + 1) / 2


def test_embeddings_against_sql(spark, small):
    check(embdedup.op8_embdedup(spark, small), small, embdedup.SQL)
