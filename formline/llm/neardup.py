"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document is its shingles of ``SHINGLE`` lower-cased words (all its words, if fewer), each weighted
by 1 + ln(count) / 8. Every shingle is a Poisson process of arrivals at the sketch's registers, faster
for larger weights; a register keeps the first shingle to arrive, so two documents agree on a
register with their probability Jaccard. Documents with repeated shingles are sketched once more
without weights, since documents whose sets are alike may be less so by weight, and agree there with
their plain Jaccard. Arrivals after the latest first arrival of all registers cannot matter, and a
shingle stops there. Sketches are banded; documents with the same words are one representative before
that. Whatever is compared is compared by a byte of each register first, and only what can still reach
the threshold by its shingles: two documents at the threshold agree on fewer than ``AGREE`` registers
with probability 6e-10.

In each band's bucket all members are compared with the least one, and the classes that come of it
resolve almost every bucket, however many copies it holds. Buckets that still hold several classes are
cut into blocks by size, and blocks whose sizes allow a link compare their members of different
classes until none is left unjoined. A link needs a similarity of ``THRESHOLD``: the Jaccard
similarity of the shingles or of the weighted ones, whichever is larger, from the whole texts.
Shingles are 32-bit hashes there, which moves the similarity of texts of 100,000 words by less than 3e-5.

Only texts of documents that share a bucket are shuffled: a bitmap of ``FILTER_BITS`` bits, whose size
does not grow, holds their ids, and lets through what it cannot tell apart; a join decides. Null, empty
and wordless texts are classes of their own. Rows that repeat a ``doc_id`` are one document, which links
by any of its texts. Ties go to the least ``doc_id``. A very long text is hashed whole, by one task. An
empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded, mix64, table
from .components import least_members

SHINGLE = 5
THRESHOLD = 0.8
#: Registers: a prime, so that a shingle's order of registers is a line modulo it. BANDS * ROWS of them are banded.
REGISTERS = 223
BANDS, ROWS = 36, 6
#: Registers that two documents at the threshold agree on, but for a chance of 6e-10 (binomial tail).
AGREE = 136
#: Members and shingles of a block where a bucket holds several classes, about.
BLOCK = 2048
BLOCK_SHINGLES = 1_000_000
#: Bits of the bitmap of wanted documents: 4 MB in all.
FILTER_BITS = 1 << 25
MEMO_WORDS = 300_000
#: A shingle's weight is 1 + ln(count) / DAMP.
DAMP = 8
SLACK = 1e-9

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


class Hasher:
    """64-bit hashes of words, with a memo."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, docs: list[list[str]]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out: list[int] = []
        for words in docs:
            try:
                out += [memo[w] for w in words]
            except KeyError:
                for w in set(words):
                    if w not in memo:
                        memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                out += [memo[w] for w in words]
        return np.array(out, dtype=np.uint64)


def shingled(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the distinct shingles of documents whose words lie end to end, sorted."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start = np.cumsum(sizes) - sizes
    n = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    of = np.repeat(np.arange(len(sizes)), n)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, dtype=np.uint64)])
    padded_doc = np.concatenate([doc, np.full(SHINGLE, -1)])
    code = np.zeros(len(at), dtype=np.uint64)
    for k in range(SHINGLE):
        inside = padded_doc[at + k] == of
        code = mix64(code ^ np.where(inside, padded[at + k], _U(k + 1)))
    order = np.lexsort((code, of))
    of, code = of[order], code[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    return of[first], code[first], np.diff(np.append(first, len(of)))


def weights(counts: np.ndarray) -> np.ndarray:
    """Damped, so that documents whose sets are alike stay alike with weights, and meet in a band."""
    return 1 + np.log(counts) / DAMP


def sketch(doc: np.ndarray, code: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """The shingle that arrives first at each register of each document, 0 where there is none."""
    m = REGISTERS
    first = np.full(n_docs * m, np.inf)
    who = np.zeros(n_docs * m, dtype=np.uint64)
    begin = (mix64(code ^ _U(0xA5A5A5A5)) % _U(m)).astype(np.int64)
    step = (mix64(code ^ _U(0x5A5A5A5A)) % _U(m - 1)).astype(np.int64) + 1
    now = np.zeros(len(doc))
    doc, code, weight = doc.astype(np.int64), code, weight
    for j in range(m):
        u = (mix64(code + _U(int(_STEP) * (j + 1) % 2**64)) >> _U(11)).astype(np.float64) * 2.0**-53
        now = now - np.log1p(-u) / (weight * (m - j))
        slot = doc * m + (begin + j * step) % m
        np.minimum.at(first, slot, now)
        won = first[slot] == now
        who[slot[won]] = code[won]
        latest = first.reshape(n_docs, m).max(axis=1) if n_docs else first
        alive = now < latest[doc]
        if not alive.all():
            doc, code, weight, now, begin, step = (x[alive] for x in (doc, code, weight, now, begin, step))
            if not len(doc):
                break
    return who.reshape(n_docs, m)


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key ^ rows[:, :, k])
    return key.view(np.int64)


def both_sketches(doc: np.ndarray, code: np.ndarray, count: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketches by weights; the documents with repeated shingles; their sketches by the set alone."""
    again = np.unique(doc[count > 1])
    of = np.isin(doc, again)
    plain = sketch(np.searchsorted(again, doc[of]), code[of], np.ones(of.sum()), len(again))
    return sketch(doc, code, weights(count), n_docs), again, plain


def band_keys(doc: np.ndarray, code: np.ndarray, count: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """Each document's distinct keys, by weights and, where they are not all one, by the set alone."""
    weighted, again, plain = both_sketches(doc, code, count, n_docs)
    keys = list(bands(weighted))
    for i, more in zip(again, bands(plain), strict=True):
        keys[i] = np.union1d(keys[i], more)
    return keys


def digests(doc: np.ndarray, code: np.ndarray, count: np.ndarray, n_docs: int) -> list[bytes]:
    """A byte of each register, by weights and then by the set alone."""
    weighted, again, plain = both_sketches(doc, code, count, n_docs)
    first = (weighted & _U(255)).astype(np.uint8)
    second = first.copy()
    second[again] = (plain & _U(255)).astype(np.uint8)
    return [x.tobytes() for x in np.concatenate([first, second], axis=1)]


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers that digests agree on, by weights or by the set, whichever are more; rows meet as in a == b."""
    first = (a[..., :REGISTERS] == b[..., :REGISTERS]).sum(axis=-1)
    return np.maximum(first, (a[..., REGISTERS:] == b[..., REGISTERS:]).sum(axis=-1))


def _words(pdf: pd.DataFrame) -> list[list[str]]:
    return [t.lower().split() for t in pdf["text"]]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, keys): a hash of the words in order, and the bands' keys; both null without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in bounded(batches, chars=1_500_000):
            words = _words(pdf)
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            doc, code, count = shingled(hasher(words), sizes)
            keys = band_keys(doc, code, count, len(words))
            whole = [xxhash.xxh3_128(" ".join(w).encode("utf-8", "surrogatepass")).intdigest() if w else None for w in words]
            low, high = ([None if x is None else ((x >> s) & (2**64 - 1)) - 2**63 for x in whole] for s in (0, 64))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "h1": pd.array(low, dtype="Int64"), "h2": pd.array(high, dtype="Int64"),
                "keys": [k if n else None for k, n in zip(keys, sizes, strict=True)],
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, h1 long, h2 long, keys array<long>")


def packed(code: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes]:
    """A document's sorted shingles as bytes: 32 bits of each, of which two unlike ones agree once in 4e9, and no counts if all are one."""
    short, at = np.unique((code >> _U(32)).astype(np.uint32), return_inverse=True)
    total = np.bincount(at, count, len(short)).astype(np.int32)
    return short.tobytes(), b"" if not len(total) or total.max() == 1 else total.tobytes()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, codes, counts, digest, size, most): the distinct shingles of each whole text, packed, and how many; the largest count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in bounded(batches, chars=1_500_000):
            words = _words(pdf)
            doc, code, count = shingled(hasher(words), np.array([len(w) for w in words], dtype=np.int64))
            ends = np.searchsorted(doc, np.arange(len(words) + 1))
            parts = [packed(code[a:b], count[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "codes": [x for x, _ in parts], "counts": [x for _, x in parts], "digest": digests(doc, code, count, len(words)),
                "size": np.diff(ends), "most": [int(count[a:b].max(initial=1)) for a, b in zip(ends, ends[1:], strict=False)],
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, codes binary, counts binary, digest binary, size long, most long")


def might_hold(ids: DataFrame, rows: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` without most of those whose ``doc_id`` is not among ``ids``: by a bitmap of hashes, which is broadcast and whose size is fixed."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    bitmap = ids.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__of", F.bitmap_bucket_number(place)).join(F.broadcast(bitmap), F.col("__of") == F.col("__part"))
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def similarity(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, threshold: float = THRESHOLD) -> float:
    """The larger of the Jaccard and the probability Jaccard similarity of two weighted sets (sorted codes, counts).

    0 may stand for less than ``threshold``, where sizes alone tell.
    """
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) and na.max() == 1 and nb.max() == 1:
        return 0.0
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    union = len(a) + len(b) - len(both)
    if not len(both):
        return 0.0
    plain = len(both) / union
    if plain >= threshold or na.max() == 1 and nb.max() == 1:
        return plain
    x, y = weights(na), weights(nb)
    # For each shared shingle, the sum of max(x_j / x_i, y_j / y_i): by order of x_j / y_j the larger side is known.
    only_x, only_y = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    xi, yi = x[i], y[j]
    order = np.argsort(xi / yi, kind="stable")
    xi, yi = xi[order], yi[order]
    above = np.cumsum(xi[::-1])[::-1]
    below = np.cumsum(yi) - yi
    return max(plain, float((1 / ((above + only_x) / xi + (below + only_y) / yi)).sum()))


def _set(codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    short = np.frombuffer(codes, np.uint32)
    return short, np.frombuffer(counts, np.int32) if counts else np.ones(len(short), dtype=np.int32)


def _matrix(digest: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digest), np.uint8).reshape(len(digest), 2 * REGISTERS)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar enough, by digests first."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.loc[agreement(_matrix(pdf["a_digest"]), _matrix(pdf["b_digest"])) >= AGREE, ["a", "b"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [similarity(*_set(r.a_codes, r.a_counts), *_set(r.b_codes, r.b_counts), threshold) >= threshold for r in pdf.itertuples()]
            yield pdf.loc[np.array(ok, dtype=bool), ["a", "b"]]

    side = lambda n, *columns: sets.select(F.col("doc_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in columns])
    open_ = pairs.join(side("a", "digest"), "a").join(side("b", "digest"), "b").mapInPandas(near, "a long, b long").distinct()
    return open_.join(side("a", "codes", "counts"), "a").join(side("b", "codes", "counts"), "b").mapInPandas(run, "a long, b long")


def _apart(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For each row that may link with later ones, or with those of the other block, their places; of other classes only."""
    digest, cls, first = _matrix(pdf["digest"]), pdf["class_id"].to_numpy(), pdf["first"].to_numpy()
    second = pdf["second"].to_numpy()
    right = np.flatnonzero(second)
    # Where no shingle repeats, both halves are one, and one comparison is enough.
    if np.array_equal(digest[:, :REGISTERS], digest[:, REGISTERS:]):
        digest = digest[:, :REGISTERS]
    for i in np.flatnonzero(first):
        # Members of one block meet in the pair that the block makes with itself.
        j = right[(cls[right] != cls[i]) & ((right > i) if second[i] else True)]
        if len(j):
            j = j[agreement(digest[i], digest[j]) >= AGREE]
            if len(j):
                yield i, j


_PAIR = ["key", "xc", "xs", "yc", "ys"]


def _taking_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one pair of blocks that may link with another class."""
    some = np.zeros(len(pdf), dtype=bool)
    if pdf["class_id"].nunique() > 1:
        for i, j in _apart(pdf):
            some[i] = some[j] = True
    return pdf.loc[some, [*_PAIR, "doc_id", "class_id", "first", "second"]].drop_duplicates()


def _linking(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between members of different classes, for one pair of blocks."""
        ids, cls = pdf["doc_id"].to_numpy(), pdf["class_id"].to_numpy().copy()
        sets = [_set(a, b) for a, b in zip(pdf["codes"], pdf["counts"], strict=True)]
        found = []
        for i, js in _apart(pdf):
            for j in js:
                if cls[i] != cls[j] and similarity(*sets[i], *sets[j], threshold) >= threshold:
                    found.append((ids[i], ids[j]))
                    cls[cls == cls[j]] = cls[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _rest(members: DataFrame, stars: DataFrame, sets: DataFrame, threshold: float, space: Workspace) -> DataFrame:
    """Links (a, b) within buckets whose members are not of one class yet."""
    of = members.select("key", F.col("rep").alias("doc_id")).join(stars.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("least", "doc_id").alias("class_id"))
    mixed = of.groupBy("key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("same")).where("low <> high and n > 2")
    # Buckets of the same members need one comparison.
    mixed = mixed.groupBy("n", "same").agg(F.min("key").alias("key")).select("key")
    # A set of n shingles with weights up to w reaches the threshold with one of threshold * n / w at least, and a
    # size class holds sizes of a ratio 1 / threshold: so that many classes below its own a member may have links.
    step = float(-np.log(threshold))
    sizes = sets.select("doc_id", F.floor(F.log("size") / step + SLACK).alias("c"), (1 + F.ceil(F.log(1 + F.log("most") / DAMP) / step)).alias("down"), "size")
    open_ = of.join(mixed, "key").join(sizes, "doc_id")
    # Written, so that the join below gets exchanges of its own, which adaptive execution may split where a block is hot.
    blocks = space.save(open_.groupBy("key", "c").agg(F.max("down").alias("down"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("parts")), "blocks")
    placed = open_.join(blocks.select("key", "c", "parts"), ["key", "c"]).select("key", "doc_id", "class_id", "c", F.pmod(F.xxhash64("doc_id", F.lit(3)), "parts").alias("s"))
    each = blocks.select("key", "c", "down", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("s"))
    low, high = (each.select("key", F.col("c").alias(f"{n}c"), F.col("s").alias(f"{n}s"), F.col("down").alias(f"{n}d")) for n in "xy")
    pairs = low.join(high, "key").where("xc < yc and yc - xc <= yd or xc = yc and xs <= ys")
    sides = F.explode(F.when((F.col("xc") == F.col("yc")) & (F.col("xs") == F.col("ys")), F.array(F.struct(F.col("xc").alias("c"), F.col("xs").alias("s"), F.lit(True).alias("first"), F.lit(True).alias("second")))).otherwise(
        F.array(F.struct(F.col("xc").alias("c"), F.col("xs").alias("s"), F.lit(True).alias("first"), F.lit(False).alias("second")), F.struct(F.col("yc").alias("c"), F.col("ys").alias("s"), F.lit(False).alias("first"), F.lit(True).alias("second")))))
    sent = pairs.select(*_PAIR, sides.alias("at")).select(*_PAIR, "at.c", "at.s", "at.first", "at.second").join(placed, ["key", "c", "s"]).select(*_PAIR, "doc_id", "class_id", "first", "second")
    part = "key long, xc long, xs long, yc long, ys long, doc_id long, class_id long, first boolean, second boolean"
    open_ = sent.join(sets.select("doc_id", "digest"), "doc_id").groupBy(*_PAIR).applyInPandas(_taking_part, part)
    return open_.join(sets.select("doc_id", "digest", "codes", "counts"), "doc_id").groupBy(*_PAIR).applyInPandas(_linking(threshold), "a long, b long")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs``: the least ``doc_id`` that links reach."""
    space = Workspace(docs.sparkSession, "neardup")
    rows = space.save(sketches(docs), "sketches")
    reps = space.save(rows.where("h1 is not null and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "reps")
    # A bucket is a band's key; keys hold the band, so the key alone names it.
    members = reps.select("rep", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1")
    members = space.save(members.join(buckets, "key").select("key", "rep", "least"), "members")
    wanted = space.save(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    # The same document may come in several rows.
    texts = might_hold(wanted, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"))
    sets = space.save(shingle_sets(texts.join(wanted, "doc_id", "left_semi").distinct()), "sets")
    pairs = members.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    edges = space.save(_verified(pairs, sets, threshold), "edges")
    stars = least_members(edges, space)
    more = space.save(_rest(members, stars, sets, threshold, space), "more")
    least = least_members(stars.select(F.col("id").alias("a"), F.col("least").alias("b")).unionByName(more), space) if more.head(1) else stars
    for done in (members, wanted, sets, edges, more):
        space.drop(done)
    of_rep = reps.select("h1", "h2", "rep").join(least.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("least", "rep").alias("class_id"))
    out = rows.select("doc_id", "h1", "h2").join(of_rep, ["h1", "h2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class and whether it is the one that stays."""
    out = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
