"""Evaluation: metrics of decisions and retrieval, calibration, paired tests, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share(flag: Column, of: Column | None = None) -> Column:
    """The share of rows with a flag, among those with ``of``; null without any."""
    of = F.lit(True) if of is None else of
    return F.count_if(flag & of) / F.nullif(F.count_if(of), F.lit(0))


def retrieval(cases: DataFrame, *by: str) -> DataFrame:
    """Recall at 1, 3 and 5, mean reciprocal rank, and misses, of cases with a gold schema (gold_rank null: not retrieved)."""
    hit = lambda k: F.avg(F.when(F.col("gold_rank") <= k, 1.0).otherwise(0.0))
    return cases.where("has_gold").groupBy(*by).agg(
        F.count("*").alias("n"), hit(1).alias("recall_1"), hit(3).alias("recall_3"), hit(5).alias("recall_5"),
        F.avg(F.when(F.col("gold_rank").isNotNull(), 1 / F.col("gold_rank")).otherwise(0.0)).alias("mrr"), F.avg(F.col("gold_rank").isNull().cast("double")).alias("miss_rate"),
    )


def observation_bucket(n: Column) -> Column:
    return F.when(n < 20, "low").when(n < 200, "mid").otherwise("high")


def decisions(cases: DataFrame, *by: str) -> DataFrame:
    """Rates of decisions (predicted, expected, correct schema) with abstention precision and recall."""
    p, e = F.col("predicted"), F.col("expected")
    return cases.groupBy(*by).agg(
        F.count("*").alias("n"),
        share(p == e).alias("accuracy"),
        share((e == "abstain"), p == "abstain").alias("abstain_precision"),
        share((p == "abstain"), e == "abstain").alias("abstain_recall"),
        share((p == "match") & (e != "match")).alias("false_merge"),
        share((p == "new") & (e == "match")).alias("false_split"),
    )


def macro_f1(cases: DataFrame, classes: list[str]) -> DataFrame:
    """Mean F1 over classes; a class that neither side has counts 0."""
    each = F.explode(F.array(*[F.lit(c) for c in classes])).alias("c")
    rows = cases.select("predicted", "expected", each)
    hit = lambda c: F.count_if(c)
    f1 = rows.groupBy("c").agg(
        hit((F.col("predicted") == F.col("c")) & (F.col("expected") == F.col("c"))).alias("tp"),
        hit((F.col("predicted") == F.col("c")) | (F.col("expected") == F.col("c"))).alias("any"),
    )
    return f1.agg(F.avg(F.when(F.col("any") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("any") + F.col("tp")))).alias("macro_f1"))


def brier_ece(cases: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error of (confidence, correct)."""
    y = F.col("correct").cast("double")
    bin_ = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    binned = cases.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(y).alias("a"), F.sum((F.col("confidence") - y) ** 2).alias("sq"))
    return binned.agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("c") - F.col("a")) * F.col("n")) / F.sum("n")).alias("ece"))


def risk_coverage(cases: DataFrame) -> DataFrame:
    """(confidence, coverage, risk): accepting all cases at or above each confidence.

    Cases are first counted by confidence, so the running sum is over its distinct values.
    """
    by = cases.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("wrong"))
    down = W.orderBy(F.desc("confidence")).rowsBetween(W.unboundedPreceding, 0)
    n, wrong = F.sum("n").over(down), F.sum("wrong").over(down)
    total = F.sum("n").over(W.partitionBy())
    return by.select("confidence", (n / total).alias("coverage"), (wrong / n).alias("risk"))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Discordant counts of (a_correct, b_correct) and the continuity-corrected statistic."""
    b, c = F.col("only_a"), F.col("only_b")
    counts = pairs.agg(F.count_if(F.col("a_correct") & ~F.col("b_correct")).alias("only_a"), F.count_if(~F.col("a_correct") & F.col("b_correct")).alias("only_b"))
    excess = F.greatest(F.abs(b - c) - 1, F.lit(0))
    return counts.withColumn("statistic", F.when(b + c == 0, 0.0).otherwise(excess * excess / (b + c)))


def bootstrap(pairs: DataFrame, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """Mean and 95 % interval of the accuracy difference of (id, a_correct, b_correct), by Poisson resampling.

    Cases are counted by their kind first. The count of a kind in a Poisson resample is Poisson, near enough normal for the
    counts that matter; each round's draws come from a hash of the seed, the round and the kind, so they are the same however the
    rows are dealt out.
    """
    diff = F.col("a_correct").cast("int") - F.col("b_correct").cast("int")
    kinds = pairs.groupBy(diff.alias("d")).agg(F.count("*").alias("n"))
    draws = pairs.sparkSession.range(rounds).select(F.col("id").alias("round")).join(F.broadcast(kinds), how="cross")
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "round", "d"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2))
    drawn = draws.withColumn("k", F.greatest(F.lit(0.0), F.round(F.col("n") + F.sqrt("n") * normal)))
    means = drawn.groupBy("round").agg((F.sum(F.col("d") * F.col("k")) / F.nullif(F.sum("k"), F.lit(0.0))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def wilson(successes: Column, n: Column, upper: bool = False, z: float = 1.959963984540054) -> Column:
    """A Wilson bound, within 0 and 1; null without cases."""
    p = successes / F.nullif(n, F.lit(0))
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = (centre + spread if upper else centre - spread) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound)))


def upper_bound_95(count: Column, n: Column) -> Column:
    """3 / n when nothing was seen, else the upper Wilson bound."""
    return F.when(count == 0, F.least(F.lit(1.0), 3 / F.nullif(n, F.lit(0)))).otherwise(wilson(count, n, upper=True))


def nearest_rank(rows: DataFrame, value: str, percents: list[float], *by: str) -> DataFrame:
    """(by, percent, value): the value at round(p / 100 * (n - 1)), half away from zero, in sorted order.

    Values are counted first; the rank is looked up in running sums over distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    up = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    run = counts.withColumn("__to", F.sum("n").over(up)).withColumn("__all", F.sum("n").over(W.partitionBy(*by)))
    asked = run.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    at = F.floor(F.col("percent") / 100 * (F.col("__all") - 1) + 0.5)
    return asked.where((at >= F.col("__to") - F.col("n")) & (at < F.col("__to"))).select(*by, "percent", F.col(value).alias("value"))


def feedback_splits(feedback: DataFrame, per_group: int = 50) -> DataFrame:
    """Feedback (id, at, cluster, family, label_source, unsafe) without repeats of a cluster, at most 50 of a family and label source, with its split.

    A fifth of the families, by the first byte of the hash of their name, is held out; unsafe rows are for safety.
    """
    one = W.partitionBy("cluster").orderBy("at", "id")
    group = W.partitionBy("family", "label_source").orderBy("at", "id")
    kept = feedback.withColumn("__n", F.row_number().over(one)).where("__n = 1").withColumn("__n", F.row_number().over(group)).where(F.col("__n") <= per_group).drop("__n")
    held = F.conv(F.substring(F.sha2("family", 256), 1, 2), 16, 10).cast("int") % 5 == 0
    return kept.withColumn("split", F.when(F.col("unsafe"), "safety").when(held, "holdout").otherwise("train"))


def tiers(events: DataFrame, newest: int, train: float) -> DataFrame:
    """Events (id, family, order) by tier: all of the newest families apart, the others' first part for training."""
    first = events.groupBy("family").agg(F.min("order").alias("born"), F.count("*").alias("n"))
    ranked = first.withColumn("age", F.row_number().over(W.orderBy(F.desc("born"), "family")))
    at = W.partitionBy("family").orderBy("order", "id")
    placed = events.join(ranked, "family").withColumn("pos", F.row_number().over(at))
    tier = F.when(F.col("age") <= newest, "cross_source").when(F.col("pos") <= F.ceil(F.col("n") * train), "train").otherwise("test")
    return placed.select("id", "family", tier.alias("tier"))


def regression_delta(candidate: DataFrame, baseline: DataFrame, metrics: list[str]) -> DataFrame:
    """Differences of one-row metric tables."""
    b = baseline.select(*[F.col(m).alias(f"__{m}") for m in metrics])
    return candidate.crossJoin(F.broadcast(b.limit(1))).select(*[(F.col(m) - F.col(f"__{m}")).alias(m) for m in metrics])


def sensitivity(runs: DataFrame, base: str, other: str) -> DataFrame:
    """(n, changed): cases whose decision differs between two runs, such as with the first two candidates swapped; from (run, id, decision)."""
    a = runs.where(F.col("run") == base).select("id", F.col("decision").alias("a"))
    b = runs.where(F.col("run") == other).select("id", F.col("decision").alias("b"))
    return a.join(b, "id").agg(F.count("*").alias("n"), share(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def difficult(cases: DataFrame, versions: DataFrame, floor: int) -> DataFrame:
    """(id, tags) of cases (id, family, fp, observations): several versions, seen too little, gold not in the pool."""
    many = versions.groupBy("family").agg((F.count("*") > 1).alias("many"))
    known = versions.select("family", "fp", F.lit(True).alias("known"))
    joined = cases.join(many, "family", "left").join(known, ["family", "fp"], "left")
    tags = F.array(F.when(F.col("many"), "multi_version"), F.when(F.col("observations") < floor, "below_floor"), F.when(F.col("known").isNull(), "gold_absent"))
    return joined.select("id", F.array_compact(tags).alias("tags"))


#: Metrics of decisions: the share of cases with a flag, among those with a condition; both in SQL.
METRICS = {
    "json_parse_rate": ("parsed", "true"), "schema_valid_rate": ("valid", "true"), "exact_accuracy": ("correct", "true"), "choice_accuracy": ("predicted = expected", "true"),
    "wrong_valid_rate": ("valid AND NOT correct", "true"), "id_violation_rate": ("id_violation", "true"), "abstain_precision": ("expected = 'abstain'", "predicted = 'abstain'"),
    "abstain_recall": ("predicted = 'abstain'", "expected = 'abstain'"), "recall_1": ("coalesce(gold_rank <= 1, false)", "has_gold"), "recall_3": ("coalesce(gold_rank <= 3, false)", "has_gold"),
    "recall_5": ("coalesce(gold_rank <= 5, false)", "has_gold"), "false_merge_rate": ("predicted = 'match' AND NOT correct", "merge_trap"), "false_split_rate": ("predicted = 'new' AND NOT correct", "split_trap"),
    "new_family_recall": ("predicted = 'new'", "expected = 'new'"), "new_family_precision": ("expected = 'new'", "predicted = 'new'"), "gold_absent_accuracy": ("predicted = 'abstain'", "NOT has_gold"),
    "injection_accuracy": ("correct", "injected"), "repair_rate": ("repairs > 0", "true"), "repair_success": ("valid", "repairs > 0"), "coverage": ("predicted <> 'abstain'", "valid"),
    "accepted_precision": ("correct", "accepted"), "timeout_rate": ("error = 'timeout'", "true"), "provider_error_rate": ("error = 'provider'", "true"), "malformed_rate": ("error = 'malformed'", "true"),
    "cache_hit_rate": ("cached", "true"), "drift_recall": ("predicted = 'match' AND correct", "category = 'compatible_drift'"), "exact_recall": ("predicted = 'match' AND correct", "category = 'known_exact'"),
    "unsafe_merge_rate": ("predicted = 'match'", "category = 'incompatible_unsafe'"),
}


def metrics(cases: DataFrame, *by: str) -> DataFrame:
    """All of ``METRICS`` in one pass, with the mean reciprocal rank, mean repairs and tokens; null where no case has the condition."""
    of = [(F.expr(f"count_if(({flag}) AND ({cond})) / nullif(count_if({cond}), 0)")).alias(n) for n, (flag, cond) in METRICS.items()]
    mrr = F.expr("sum(CASE WHEN has_gold AND gold_rank IS NOT NULL THEN 1 / gold_rank ELSE 0 END) / nullif(count_if(has_gold), 0)").alias("mrr")
    return cases.groupBy(*by).agg(F.count("*").alias("n"), *of, mrr, F.avg("repairs").alias("mean_repairs"), F.avg("tokens").alias("mean_tokens"))


def worst_slice(cases: DataFrame, by: str, least: int = 1) -> DataFrame:
    """The slice of at least so many cases with the lowest accuracy, and its name; ties by name."""
    each = cases.groupBy(by).agg(F.count("*").alias("n"), share(F.col("correct")).alias("accuracy")).where(F.col("n") >= least)
    return each.orderBy("accuracy", by).limit(1)


def relation_confusion(cases: DataFrame) -> DataFrame:
    """(expected_relation, predicted_relation, n) of cases that both sides match."""
    return cases.where("expected = 'match' and predicted = 'match'").groupBy("expected_relation", "predicted_relation").agg(F.count("*").alias("n"))


def multiset_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs that share an item, from (a, item, n) and (b, item, n): shared counts over the larger ones."""
    both = a.join(b.withColumnRenamed("n", "__n"), "item").groupBy("a", "b").agg(F.sum(F.least("n", "__n")).alias("s"))
    size = lambda x, k: x.groupBy(k).agg(F.sum("n").alias(f"__{k}"))
    return both.join(size(a, "a"), "a").join(size(b, "b"), "b").select("a", "b", (F.col("s") / (F.col("__a") + F.col("__b") - F.col("s"))).alias("similarity"))


def repeatability(runs: DataFrame) -> DataFrame:
    """(n, repeated): cases (run, id, decision) that all runs decide alike."""
    each = runs.groupBy("id").agg((F.count_distinct(F.coalesce("decision", F.lit(""))) == 1).alias("same"))
    return each.agg(F.count("*").alias("n"), share(F.col("same")).alias("repeated"))


def field_additions(versions: DataFrame) -> DataFrame:
    """(schema_id, added): whether a version's top-level fields strictly hold those of an earlier version of its family that has any; from (schema_id, family_id, version, keys)."""
    earlier = versions.select("family_id", F.col("version").alias("__v"), F.col("keys").alias("__k"))
    pairs = versions.join(earlier, "family_id", "left").withColumn("__before", F.coalesce(F.col("__v") < F.col("version"), F.lit(False)))
    more = F.col("__before") & (F.size("__k") > 0) & (F.size(F.array_except("__k", "keys")) == 0) & (F.size(F.array_except("keys", "__k")) > 0)
    return pairs.groupBy("schema_id").agg(F.bool_or(F.coalesce(more, F.lit(False))).alias("added"))


def histogram(rows: DataFrame, value: str, *by: str, digits: int = 3) -> DataFrame:
    """(by, low, n): counts of whole values that are not negative, by their first digits; ``low`` is the least value of a bucket, so no value is off by more than one in 10 ** (digits - 1)."""
    step = F.pow(F.lit(10), F.greatest(F.length(F.col(value).cast("string")) - digits, F.lit(0))).cast("long")
    return rows.where(F.col(value) >= 0).groupBy(*by, (F.floor(F.col(value) / step) * step).cast("long").alias("low")).agg(F.count("*").alias("n"))


#: What a counter may be labelled by; anything else is "other", so that series stay few.
REASONS = ("size_exceeded", "depth_exceeded", "field_count_exceeded", "key_length_exceeded", "duplicate_key", "parse_error", "utf8_error")


def counters(classified: DataFrame) -> DataFrame:
    """(series, label, value) of classified records: by fate, by reason of quarantine, and records and bytes in all."""
    reason = F.when(F.col("reason").isin(*REASONS), F.col("reason")).otherwise("other")
    each = F.array_compact(F.array(
        F.struct(F.lit("records_total").alias("series"), F.lit("").alias("label"), F.lit(1).cast("long").alias("x")), F.struct(F.lit("fate_total").alias("series"), F.col("fate").alias("label"), F.lit(1).cast("long").alias("x")),
        F.when(F.col("fate") == "malformed", F.struct(F.lit("quarantine_total").alias("series"), reason.alias("label"), F.lit(1).cast("long").alias("x"))),
        F.struct(F.lit("bytes_total").alias("series"), F.lit("").alias("label"), F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("x")),
    ))
    return classified.select(F.explode(each).alias("e")).groupBy(F.col("e.series").alias("series"), F.col("e.label").alias("label")).agg(F.sum("e.x").alias("value"))
