"""Policy gates over proposed matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import share

MAX_DISTANCE, MIN_MARGIN, MIN_OBSERVATIONS = 0.15, 0.10, 20


def gate_reasons() -> Column:
    """All reasons against applying a match, in order; empty if it may be applied.

    Columns: is_match, rank, distance, margin, observations, relation, compatible, collision.
    """
    checks = [
        (~F.col("is_match"), "no_match_proposed"),
        (~F.col("rank").eqNullSafe(F.lit(1)), "rank_not_one"),
        (~F.coalesce(F.col("distance") <= MAX_DISTANCE, F.lit(False)), "distance_exceeded"),
        (F.col("margin") < MIN_MARGIN, "margin_too_small"),
        (F.col("observations") < MIN_OBSERVATIONS, "insufficient_observations"),
        (~F.coalesce(F.col("relation").isin("exact", "compatible_drift"), F.lit(False)), "relation_not_eligible"),
        (~F.col("compatible"), "deterministic_compatibility_failed"),
        (F.col("collision"), "redaction_collision"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in checks]), lambda x: x.isNotNull())


def redaction_collision(paths: DataFrame, by: str) -> DataFrame:
    """Whether two fields of a candidate have the same masked path."""
    return paths.groupBy(by).agg((F.count("path") != F.count_distinct("path")).alias("collision"))


def trusted_verdict(enabled: Column, reasons: Column, family_trusted: Column) -> Column:
    return F.when(~enabled, "shadow_only").when(F.size(reasons) > 0, "reject").when(family_trusted, "apply").otherwise("propose")


def unseen(cases: DataFrame, seen: DataFrame) -> DataFrame:
    """Cases (candidate, candidate_set) that no earlier sweep classified."""
    keyed = cases.withColumn("set_hash", F.sha2(F.array_join(F.sort_array("candidate_set"), "\0"), 256))
    return keyed.join(seen.select("candidate", "set_hash"), ["candidate", "set_hash"], "left_anti")


EXACT = 1e-6


def top_one(asked: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query, decision, schema_id, detail): the nearest schema whatever its distance; with none it abstains."""
    first = ranked.where("rank = 1").select("query", "schema_id")
    none = F.col("schema_id").isNull()
    return asked.select("query").distinct().join(first, "query", "left").select("query", F.when(none, "abstain").otherwise("match").alias("decision"), "schema_id", F.when(none, "candidate_missing").otherwise("exact").alias("detail"))


def deterministic(asked: DataFrame, ranked: DataFrame, max_distance: float = MAX_DISTANCE, min_margin: float = MIN_MARGIN, least: int = MIN_OBSERVATIONS) -> DataFrame:
    """(query, decision, detail) of candidates (query, observations): abstains without a schema, on little evidence, or if two are near; new if all are far.

    ``margin`` is 0 with fewer than two, so a single near schema is no clear case.
    """
    first = ranked.where("rank = 1").select("query", "distance", "margin")
    rows = asked.select("query", "observations").join(first, "query", "left")
    cases = [
        (F.col("distance").isNull(), "abstain", "candidate_missing"), (F.col("observations") < least, "abstain", "insufficient_evidence"),
        (F.col("distance") > max_distance, "new", "structural"), (F.col("margin") < min_margin, "abstain", "ambiguous"), (F.col("distance") <= EXACT, "match", "exact"),
    ]
    pick = lambda i, last: F.coalesce(*[F.when(c[0], F.lit(c[i])) for c in cases], F.lit(last))
    return rows.select("query", pick(1, "match").alias("decision"), pick(2, "compatible_drift").alias("detail"))


def gated(decided: DataFrame, reasons: DataFrame) -> DataFrame:
    """(query, decision, reasons): a proposed match that the gate has reasons against becomes an abstention; from (query, decision) and (query, reasons)."""
    rows = decided.join(reasons, "query", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    return rows.select("query", F.when((F.col("decision") == "match") & (F.size("reasons") > 0), "abstain").otherwise(F.col("decision")).alias("decision"), "reasons")


def containment(cases: DataFrame) -> DataFrame:
    """(n, blocked, bad_blocked, good_passed, coverage) of proposed matches (correct, reasons): what the gate holds back, and what of the right ones gets through."""
    stopped = F.size("reasons") > 0
    return cases.agg(
        F.count("*").alias("n"), F.count_if(stopped).alias("blocked"), share(stopped, ~F.col("correct")).alias("bad_blocked"),
        share(~stopped, F.col("correct")).alias("good_passed"), share(~stopped).alias("coverage"),
    )


def guard_histogram(cases: DataFrame) -> DataFrame:
    """(reason, n): how often each guard spoke."""
    return cases.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
