"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches in the order of ``doc_id``. A run holds hashes of lines with the document
that had each first, bucketed and sorted by hash, one file a bucket. A new batch counts its own distinct
lines before any shuffle, merges them against the runs (both sides bucketed and sorted alike, so no run
is shuffled or sorted again), drops lines that a run or a smaller document of the batch has, and adds a
run of the lines that no run had. Once a level has ``fanout`` runs, they merge into one of the next
level, and their files go.

Null or empty texts are one empty line. A document is a ``doc_id``: rows that repeat one are the
same document. Rows without ``doc_id`` lose nothing and own nothing. A line of several documents stays in
the least ``doc_id``, however often that holds it. A very long text is split whole, by one task, in time
and memory that follow its length. An empty table gives an empty one. Other columns pass through
unchanged, but for those named like one of ``ADDED``, which the operator's own replace.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Workspace, remove, table

MIN_CHARS = 10
BATCHES = 4
FANOUT = 3
#: Columns that the operator adds.
ADDED = ("kept_text", "n_lines", "n_dropped")
#: Lets a scan of a bucketed table with one file a bucket say that it is sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), ascii_uppercase, ascii_lowercase)


def hashed(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, place, h1, h2) of the lines that count; 128 bits of hash, so that a collision stays unlikely at 10^12 lines."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    keys = lines.select("doc_id", "version", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "version", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


class LineRuns:
    """Sorted runs of line hashes by level. A batch's documents must be larger than earlier ones."""

    def __init__(self, space: Workspace, buckets: int, fanout: int = FANOUT):
        self.space, self.buckets, self.fanout = space, buckets, fanout
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}
        self.met: list[DataFrame] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"formline_run_{uuid.uuid4().hex}"
        self.paths[name] = self.space.path("run")
        dealt = keys.repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def merged(self, lines: DataFrame) -> DataFrame:
        """A batch's distinct lines with the least and the largest document of the batch, and the earlier one that owns it."""
        met = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).withColumn("earlier", F.lit(None).cast("long"))
        for name in self.runs():
            run = self.space.spark.table(name).withColumnRenamed("owner", "found").hint("merge")
            met = met.join(run, ["h1", "h2"], "left").withColumn("earlier", F.coalesce("earlier", "found")).drop("found")
        return met

    def absorb(self, lines: DataFrame) -> DataFrame:
        """The lines (doc_id, version, place) of this batch that are dropped; its new lines become a run."""
        with setting(self.space.spark, ORDERED, "true"):
            met = self.space.save(self.merged(lines), "met")
        self.met.append(met)  # the returned rows read it
        self.levels[0].append(self._write(met.where("earlier is null").select("h1", "h2", F.col("least").alias("owner"))))
        self._compact()
        repeated = met.where("earlier is not null or most > least").select("h1", "h2", F.coalesce("earlier", "least").alias("owner"))
        return lines.join(repeated, ["h1", "h2"]).where("doc_id > owner").select("doc_id", "version", "place")

    def _compact(self) -> None:
        spark = self.space.spark
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(reduce(DataFrame.unionByName, map(spark.table, level))))
                self._drop(level)
                self.levels[i] = []

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.space.spark.sql(f"DROP TABLE {name}")
            remove(self.space.spark, self.paths.pop(name))

    def forget(self) -> None:
        """Drops the runs and what batches wrote, files and all."""
        self._drop(self.runs())
        for met in self.met:
            self.space.drop(met)
        self.met = []
        self.levels = [[]]


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, version, places): the places of a document's lines that go, for documents that lose any."""
    spark = docs.sparkSession
    space = Workspace(spark, "linededup")
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    batch = reduce(lambda a, c: a + (F.col("doc_id") > c).cast("int"), sorted(set(cuts)), F.lit(0))
    # Batches are ranges of doc_id, so the files' own bounds let a batch's scan pass over the others where the table is in that order.
    lines = space.save(hashed(docs, min_chars).withColumn("batch", batch), "lines")
    runs = LineRuns(space, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    gone = [space.save(runs.absorb(lines.where(F.col("batch") == i)), "gone") for i in range(len(set(cuts)) + 1)]
    runs.forget()
    space.drop(lines)
    return reduce(DataFrame.unionByName, gone).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("place")).alias("places"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with the columns of ``ADDED``."""
    gone = dropped_lines(docs.select("doc_id", "text"), min_chars, batches, fanout).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("places").alias("__places"))
    # Columns that the operator does not read go in one, so that no name meets one of its own.
    kept = [c for c in docs.columns if c not in ADDED]
    rest = [c for c in kept if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("boolean")).alias("__rest"))
    text = F.coalesce("text", F.lit(""))
    joined = packed.join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("__id")) & (F.xxhash64(text) == F.col("__version")), "left")
    # A flag for each line, made from the gaps between dropped places: time and memory follow the number of lines.
    flags = """concat(flatten(transform(__places, (p, k) -> concat(array_repeat(true, p - coalesce(get(__places, k - 1), -1) - 1), array(false)))),
                      array_repeat(true, size(__lines) - element_at(__places, -1) - 1))"""
    left = f"array_join(transform(array({flags}), f -> filter(__lines, (x, i) -> get(f, i)))[0], '\\n')"
    out = joined.withColumn("__lines", F.split(text, "\n"))
    return out.select(
        *[F.col(c) if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in kept],
        F.when(F.col("__places").isNull(), text).otherwise(F.expr(left)).alias("kept_text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__places"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines dropped, and the hash of what stays."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.doc_id > o.owner) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.owner IS NULL OR k.doc_id = o.owner), '')) AS kept_sha256
FROM k LEFT JOIN o ON k.key = o.key GROUP BY k.doc_id
"""
