"""Near-duplicates among embeddings: tiles in PCA order, compared leading dimensions first.

Vectors are scaled to length one and rotated onto the principal axes of all of them, whose moments
are sums over the table, added up by partition. Equal vectors become one row with a count before
anything is compared. A tree of cuts along the leading axes, fitted on ``SAMPLE`` vectors, deals rows
to leaves, and a leaf with many rows to several tiles; the cuts only order the work. Two vectors with
cosine c are sqrt(2 - 2c) apart, and no further apart on the leading axes, so only tiles of leaves
whose boxes there, taken over all rows, come that close are paired. A tile is shuffled as packed
components in the input's own type. A pair of tiles is compared block by block: the leading dimensions
are multiplied first, what the others can still add is bounded by the product of the suffix norms, and
only pairs that can reach the threshold are carried on; those are decided in double precision. A pair of
tiles returns link counts and a spanning forest of its links, never the links themselves, so a
group of near copies costs rows in proportion to its size for each pair of tiles. Components are the least ids over the forests.

Null vectors, vectors with null or non-finite components and zero vectors link with nothing, and so do
rows without ``vec_id``, which are kept and have no component. Vectors of different lengths do not link;
each length is compared by itself. Rows that repeat a ``vec_id`` count as rows and share its component.
Ties go to the least ``vec_id``. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table
from .components import least_members

THRESHOLD = 0.95
#: Rows and bytes of a tile at most, about; rows of the blocks in which two tiles are compared; dimensions multiplied at a time.
TILE_ROWS = 16_384
TILE_BYTES = 4 << 20
BLOCK_ROWS = 1024
LEADING = 16
#: Vectors that the cuts are fitted on, and the fewest of them in a leaf: so at most SAMPLE / LEAF leaves.
SAMPLE = 20_000
LEAF = 16
#: Room for rounding wherever a bound decides.
SLACK = 1e-6


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector can link, in the type it has."""
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v")).where(fine)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def axes(rows: DataFrame, dims: int, n: int) -> np.ndarray:
    """Principal axes, largest variance first, of the unit vectors; sums of dims^2 numbers by partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims + 1, dims))
        for pdf in batches:
            if len(pdf):
                u = _unit(_matrix(pdf["v"]))
                total += np.concatenate([u.sum(axis=0, keepdims=True), u.T @ u])
        yield pd.DataFrame({"i": np.arange(total.size), "x": total.ravel()})

    sums = rows.select("v").mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    n = max(1, n)
    total = np.array([r["x"] for r in sums]).reshape(dims + 1, dims) if sums else np.zeros((dims + 1, dims))
    values, vectors = np.linalg.eigh(total[1:] / n - np.outer(total[0] / n, total[0] / n))
    return vectors[:, np.argsort(-values, kind="stable")]


def _links(va: np.ndarray, ra: np.ndarray, vb: np.ndarray, rb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with cosine at least the threshold; r are rotated, v the unit vectors as given."""
    k = min(LEADING, ra.shape[1])
    head = ra[:, :k] @ rb[:, :k].T
    bound = np.sqrt(np.maximum(0, 1 - (ra[:, :k] ** 2).sum(axis=1)))[:, None] * np.sqrt(np.maximum(0, 1 - (rb[:, :k] ** 2).sum(axis=1)))[None, :]
    i, j = np.nonzero(head + bound >= threshold - SLACK)
    # Pairs still open go on in steps of the next dimensions, and the last word is the plain product.
    part = head[i, j]
    for lo in range(k, ra.shape[1], LEADING):
        if not len(i):
            break
        hi = min(lo + LEADING, ra.shape[1])
        part = part + np.einsum("ij,ij->i", ra[i, lo:hi], rb[j, lo:hi])
        rest = np.sqrt(np.maximum(0, (ra[i, hi:] ** 2).sum(axis=1)) * np.maximum(0, (rb[j, hi:] ** 2).sum(axis=1)))
        ok = part + rest >= threshold - SLACK
        i, j, part = i[ok], j[ok], part[ok]
    if len(i):
        ok = np.einsum("ij,ij->i", va[i], vb[j]) >= threshold
        i, j = i[ok], j[ok]
    return i, j


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the trees of i and j; every entry of ``parent`` is a root, and the least of its tree."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


class Cuts:
    """A tree of cuts: node k has children 2k + 1 and 2k + 2, and cuts one axis or is a leaf."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis: dict[int, int] = {}
        self.at: dict[int, float] = {}
        open_ = [(0, sample)]
        while open_ and len(self.axis) + 1 < leaves:
            open_.sort(key=lambda x: -len(x[1]))
            k, rows = open_.pop(0)
            spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
            if len(rows) < 2 * LEAF or not spread.max() > 0:
                break
            self.axis[k] = d = int(spread.argmax())
            self.at[k] = float(np.median(rows[:, d]))
            low = rows[:, d] < self.at[k]
            open_ += [(2 * k + 1, rows[low]), (2 * k + 2, rows[~low])]

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.int64)
        open_ = [(0, np.arange(len(rows)))]
        while open_:
            k, at = open_.pop()
            if k not in self.axis:
                out[at] = k
            elif len(at):
                low = rows[at, self.axis[k]] < self.at[k]
                open_ += [(2 * k + 1, at[low]), (2 * k + 2, at[~low])]
        return out


def near_leaves(boxes: list, radius: float) -> list[tuple[int, int]]:
    """Pairs (x, y), x <= y, of leaves whose boxes come within the radius; a box is (leaf, lows, highs)."""
    leaf = np.array([b[0] for b in boxes])
    low, high = (np.array([b[i] for b in boxes], dtype=np.float64).reshape(len(boxes), -1) for i in (1, 2))
    out = []
    for i in range(len(boxes)):
        gap = np.maximum(0, np.maximum(low[i] - high, low - high[i]))
        near = (gap**2).sum(axis=1) <= radius**2
        out += [(int(leaf[i]), int(x)) for x in leaf[near & (leaf >= leaf[i])]]
    return out


def compare(a: tuple, b: tuple | None, turn: np.ndarray, threshold: float) -> pd.DataFrame:
    """(vec_id, links, least) for rows with a link within tile ``a``, or between ``a`` and ``b``; a tile is (ids, counts, vectors)."""
    ids, counts, v = a if b is None else tuple(np.concatenate(x) for x in zip(a, b, strict=True))
    v = _unit(v.astype(np.float64))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))  # so that the least place is the least id
    r = v @ turn
    links, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    n_a = len(a[0])
    left = range(0, n_a, BLOCK_ROWS)
    for x in left:
        for y in range(x, n_a, BLOCK_ROWS) if b is None else range(n_a, len(ids), BLOCK_ROWS):
            x2, y2 = min(x + BLOCK_ROWS, n_a), min(y + BLOCK_ROWS, n_a if b is None else len(ids))
            i, j = _links(v[x:x2], r[x:x2], v[y:y2], r[y:y2], threshold)
            i, j = i + x, j + y
            if b is None and x == y:
                i, j = i[i < j], j[i < j]
            links += np.bincount(i, counts[j], len(ids)).astype(np.int64) + np.bincount(j, counts[i], len(ids)).astype(np.int64)
            parent = _merge(parent, place[i], place[j])
    has = links > 0
    return pd.DataFrame({"vec_id": ids[has], "links": links[has], "least": ids[order][parent[place[has]]]})


def linked(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id) of rows that link with another row."""
    spark = vectors.sparkSession
    space = Workspace(spark, "embdedup")
    good = usable(vectors).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    sizes = [r["d"] for r in good.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]
    if not sizes:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id")).limit(0)
    each = [_linked(good.where(F.size("v") == d), d, space, threshold, tile_rows) for d in sizes]
    if len(each) == 1:
        return each[0]
    # An id may have vectors of several lengths; its components are one.
    every = space.save(reduce(DataFrame.unionByName, [x.distinct() for x in each]), "lengths")
    least = least_members(every.select(F.col("vec_id").alias("a"), F.col("component_id").alias("b")), space)
    return every.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("c")).join(least.withColumnRenamed("id", "vec_id"), "vec_id", "left").select("vec_id", "n_links", F.coalesce("least", "c").alias("component_id"))


def _linked(good: DataFrame, dims: int, space: Workspace, threshold: float, tile_rows: int | None) -> DataFrame:
    """The same for usable vectors of one length, hashed."""
    spark = good.sparkSession
    kind = np.dtype(np.float32 if good.schema["v"].dataType.elementType.simpleString() == "float" else np.float64)
    tile_rows = tile_rows or max(1, min(TILE_ROWS, TILE_BYTES // (dims * kind.itemsize)))
    reps = space.save(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("v").alias("v")), "reps")
    turn = axes(reps, dims, total := reps.count())
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    used = min(LEADING, dims)

    def leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"r": list(_unit(_matrix(pdf["v"])) @ turn[:, :used])})

    few = reps.orderBy("h1", "h2").limit(SAMPLE).select("v").mapInPandas(leading, "r array<double>").collect()
    cuts = Cuts(np.array([r["r"] for r in few]).reshape(len(few), used), -(-total // tile_rows))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=cuts.leaf(_unit(_matrix(pdf["v"])) @ turn[:, :used]))

    item = good.schema["v"].dataType.simpleString()
    placed = space.save(reps.select("vec_id", "n", "v").mapInPandas(place, f"vec_id long, n long, v {item}, leaf long"), "placed")
    leaves = placed.groupBy("leaf").agg(F.ceil(F.count("*") / tile_rows).cast("long").alias("tiles"))  # at most SAMPLE / LEAF rows
    tile = F.pmod(F.xxhash64("vec_id"), F.col("tiles")).alias("part")

    def to_blob(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf["v"])
        r = _unit(m) @ turn[:, :used]
        return pd.DataFrame({"leaf": [key[0]], "part": [key[1]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "ns": [pdf["n"].to_numpy(np.int64).tobytes()], "vs": [m.astype(kind).tobytes()], "low": [r.min(axis=0)], "high": [r.max(axis=0)]})

    blobs = placed.join(F.broadcast(leaves), "leaf").select("vec_id", "n", "v", "leaf", tile).groupBy("leaf", "part").applyInPandas(to_blob, "leaf long, part long, ids binary, ns binary, vs binary, low array<double>, high array<double>")
    blobs = space.save(blobs, "tiles")
    boxes = blobs.groupBy("leaf").agg(*[F.min(F.col("low")[i]).alias(f"l{i}") for i in range(used)], *[F.max(F.col("high")[i]).alias(f"h{i}") for i in range(used)]).orderBy("leaf").collect()
    near = near_leaves([(b[0], b[1 : used + 1], b[used + 1 :]) for b in boxes], radius)
    near = spark.createDataFrame(pd.DataFrame(near, columns=["xl", "yl"], dtype="int64"), "xl long, yl long")
    side = lambda n: blobs.select(F.col("leaf").alias(f"{n}l"), F.col("part").alias(f"{n}p"))
    pairs = near.join(side("x"), "xl").join(side("y"), "yl").where("xl < yl or xp <= yp").select("xl", "xp", "yl", "yp")
    both = F.array_distinct(F.array(F.struct(F.col("xl").alias("leaf"), F.col("xp").alias("part")), F.struct(F.col("yl").alias("leaf"), F.col("yp").alias("part"))))
    sent = pairs.withColumn("at", F.explode(both)).select("xl", "xp", "yl", "yp", "at.leaf", "at.part").join(blobs.drop("low", "high"), ["leaf", "part"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        by_tile = {(r.leaf, r.part): (np.frombuffer(r.ids, np.int64), np.frombuffer(r.ns, np.int64), np.frombuffer(r.vs, kind).reshape(-1, dims)) for r in pdf.itertuples()}
        return compare(by_tile[key[:2]], by_tile[key[2:]] if key[:2] != key[2:] else None, turn, threshold)

    found = space.save(sent.groupBy("xl", "xp", "yl", "yp").applyInPandas(run, "vec_id long, links long, least long"), "found")
    for done in (placed, blobs):
        space.drop(done)
    stars = least_members(found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")), space)
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    of_rep = reps.select("h1", "h2", "n", "vec_id").join(links, "vec_id", "left").join(stars.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    of_rep = of_rep.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id")).where("n_links > 0")
    return good.select("vec_id", "h1", "h2").join(of_rep, ["h1", "h2"]).select("vec_id", "n_links", "component_id")


def classes(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    found = linked(vectors, threshold).withColumnRenamed("vec_id", "__id").distinct()
    out = vectors.select("vec_id").join(found, F.col("vec_id") == F.col("__id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op8_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE e IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a, u b
      WHERE a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT r.s, l.y FROM r JOIN l ON r.t = l.x),
c AS (SELECT s, min(t) AS component_id FROM r GROUP BY s)
SELECT v.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN c ON c.s = v.vec_id LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON k.x = v.vec_id
"""
