"""Model governance and the curation of examples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluate import share, upper_bound_95, wilson

#: What may follow each state of a model.
TRANSITIONS = {"candidate": ["shadow", "rejected"], "shadow": ["active", "rejected"], "active": ["rolled_back"], "rejected": [], "rolled_back": ["active"]}


@dataclass(frozen=True)
class Gate:
    """What a model must reach, and how much it may lose against the active one."""

    min_cases: int = 200
    max_wrong_valid: float = 0.005
    min_precision: float = 0.995
    min_family_cases: int = 20
    min_family_bound: float = 0.99
    min_recall_5: float = 0.95
    margin: float = 0.01
    recall_margin: float = 0.02
    max_false_merge_bound: float = 0.01


def evidence(cases: DataFrame, *by: str) -> DataFrame:
    """Aggregates of a model's cases (accepted, correct, valid, trap, false_merge, has_gold, gold_rank), as the gate reads them."""
    return cases.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("trap").alias("n_traps"), F.count_if(F.col("trap") & F.col("false_merge")).alias("n_false_merges"),
        share(F.col("valid") & ~F.col("correct")).alias("wrong_valid"), share(F.col("correct")).alias("accuracy"),
        F.coalesce(share(F.col("correct"), F.col("accepted")), F.lit(0.0)).alias("precision"),
        share(F.coalesce(F.col("gold_rank") <= 5, F.lit(False)), F.col("has_gold")).alias("recall_5"),
    )


def gate(cases: DataFrame, rules: Gate = Gate(), by: str = "model") -> DataFrame:
    """(model, reasons): all that speaks against a model's cases (model, family, and those of ``evidence``), in order; empty if it passes.

    Any false merge is one, and so is an upper bound of their rate that too few traps leave too wide. A family of few cases is
    not judged; others need a lower Wilson bound.
    """
    e = evidence(cases, by).withColumn("bound", F.when(F.col("n_traps") > 0, upper_bound_95(F.col("n_false_merges"), F.col("n_traps"))))
    families = cases.groupBy(by, "family").agg(F.count("*").alias("n"), F.count_if("correct").alias("k"))
    low = families.where(F.col("n") >= rules.min_family_cases).where(wilson(F.col("k"), F.col("n")) < rules.min_family_bound)
    bad = low.groupBy(by).agg(F.sort_array(F.collect_list(F.concat_ws(":", F.lit("family_bound"), "family"))).alias("__families"))
    checks = F.array_compact(F.array(
        F.when(F.col("n") < rules.min_cases, "too_few_cases"), F.when(F.col("n_false_merges") > 0, "false_merges"), F.when(F.col("bound") > rules.max_false_merge_bound, "false_merge_bound"),
        F.when(F.col("wrong_valid") > rules.max_wrong_valid, "wrong_valid"), F.when(F.col("precision") < rules.min_precision, "precision"), F.when(F.col("recall_5") < rules.min_recall_5, "recall_5"),
    ))
    return e.join(bad, by, "left").select(by, F.concat(checks, F.coalesce("__families", F.array().cast("array<string>"))).alias("reasons"))


def regressions(candidates: DataFrame, active: DataFrame, rules: Gate = Gate(), by: str = "model") -> DataFrame:
    """(model, reasons): where each model's evidence falls behind the active one's single row; false merges have no margin."""
    a = active.select(*[F.col(c).alias(f"__{c}") for c in ("n_false_merges", "accuracy", "wrong_valid", "recall_5")])
    rows = candidates.join(F.broadcast(a.limit(1)), how="cross")
    reasons = F.array_compact(F.array(
        F.when(F.col("n_false_merges") > F.col("__n_false_merges"), "false_merges"), F.when(F.col("accuracy") + rules.margin < F.col("__accuracy"), "accuracy"),
        F.when(F.col("wrong_valid") > F.col("__wrong_valid") + rules.margin, "wrong_valid"), F.when(F.col("recall_5") + rules.recall_margin < F.col("__recall_5"), "recall_5"),
    ))
    return rows.select(by, reasons.alias("reasons"))


def replay(events: DataFrame) -> DataFrame:
    """Events (model, at, wanted) with the state before and whether the step is allowed, given that only allowed steps count.

    A model's events are few; they are folded in order within its row.
    """
    ordered = events.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("at", "wanted"))).alias("steps"))
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    start = F.struct(F.lit("candidate").alias("state"), F.array().cast("array<struct<at:bigint,was:string,wanted:string,ok:boolean>>").alias("log"))

    def step(acc, s):
        ok = F.array_contains(F.element_at(allowed, acc["state"]), s["wanted"])
        entry = F.struct(s["at"].cast("bigint").alias("at"), acc["state"].alias("was"), s["wanted"].alias("wanted"), ok.alias("ok"))
        return F.struct(F.when(ok, s["wanted"]).otherwise(acc["state"]).alias("state"), F.concat(acc["log"], F.array(entry)).alias("log"))

    done = ordered.select("model", F.aggregate("steps", start, step).alias("r"))
    return done.select("model", F.explode("r.log").alias("e")).select("model", "e.*")


def curate(cases: DataFrame, easy: int = 3) -> DataFrame:
    """Cases (id, family, kind, margin) to train on: all but easy positives, of which each family's narrowest few."""
    order = W.partitionBy("family", "kind").orderBy(F.col("margin").asc_nulls_last(), "id")
    return cases.withColumn("__n", F.row_number().over(order)).where((F.col("kind") != "easy_positive") | (F.col("__n") <= easy)).drop("__n")


def without_actors(examples: DataFrame, quarantined: DataFrame) -> DataFrame:
    return examples.join(quarantined.select("actor").distinct(), "actor", "left_anti")


def family_versions(events: DataFrame) -> DataFrame:
    """(family, fp, version) by the first appearance of each shape in its family; from (family, fp, order)."""
    first = events.groupBy("family", "fp").agg(F.min("order").alias("first"))
    return first.select("family", "fp", F.row_number().over(W.partitionBy("family").orderBy("first", "fp")).alias("version"))
