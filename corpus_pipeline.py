"""From raw documents to packed training sequences, in stages that are each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept: quality rules drop
documents, line dedup edits texts and drops those left without a word, near-dedup keeps one row of each group (the
least ``doc_id``, null last; then the least hash of the text; then the first row), mixing repeats documents by their rates (which are at least one, so none is lost), and packing returns pieces of
sequences. Nulls, empty tables and repeated rows are as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm import linededup, mixing, neardup, packing, quality
from formline.llm.common import SPACES, Workspace
from formline.session import ship


def _apart(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that a stage reads, and all others in one, so that no name meets one of the stage's."""
    rest = [c for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*rest) if rest else F.lit(None)).alias("__rest"))


def _together(rows: DataFrame, columns: list[str], **own: Column) -> DataFrame:
    return rows.select(*[(own[c] if c in own else F.col("__rest")[c]).alias(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One policy, once: the entries of the ledger stay beside their rows and are not written apart."""
    rows = docs.select("text", F.struct(*docs.columns).alias("__all"))
    return quality.judged(rows, "__all").where(quality.passes("v1")).select(*[F.col("__all")[c].alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_apart(docs, "doc_id", "text"))
    left = out.where(F.btrim("kept_text", F.lit(SPACES)) != "")
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return _together(left, docs.columns, **own)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").head(1):
        gone = neardup.classes(docs.select("doc_id", "text")).where("class_id <> doc_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Ids do not name rows here: rows are numbered, and written so that their numbers stay.
    rows = Workspace(spark, "near-dedup").save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("all")), "rows")
    of = neardup.classes(rows.select(F.col("row").alias("doc_id"), F.col("all.text").alias("text"))).withColumnRenamed("doc_id", "row")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash", "row")
    named = rows.select("row", F.col("all.doc_id").alias("doc_id"), F.sha2("all.text", 256).alias("hash")).join(of, "row")
    kept = named.groupBy("class_id").agg(F.min(place)["row"].alias("row"))
    return rows.join(kept, "row", "left_semi").select(*[F.col("all")[c].alias(c) for c in docs.columns])


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    mixed = mixing.mix(_apart(docs, "doc_id", "text", "lang"), mixing.domains_of(docs), least=1.0)
    own = ("doc_id", "text", "lang")
    return _together(mixing.repeat(mixed, [*own, "__rest"]), docs.columns, **{c: F.col(c) for c in own})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_of_each),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: No SQL expresses training a classifier or the tokenizer; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
