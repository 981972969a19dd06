"""The cold lane: clustering of unknown shapes, evidence, and promotion by policy."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.identity import DEFAULT_TAGS, IdentityTags, bucket_key
from ..session import ship
from . import profile, registry


@dataclass(frozen=True)
class PromotionPolicy:
    min_samples: int = 10
    min_age_ms: int = 5 * 60_000

    def reason(self) -> Column:
        """Why a candidate (samples, first_seen, now in ms) waits; null if it may be promoted."""
        age = F.col("now") - F.col("first_seen")
        return F.when(F.col("samples") < self.min_samples, "too_few_samples").when(age < self.min_age_ms, "too_young")


@dataclass(frozen=True)
class AutoPromotePolicy:
    min_samples: int = 50
    min_age_ms: int = 10 * 60_000
    min_required: int = 2
    min_ratio: float = 0.5
    slack: float = 1e-9

    def reason(self) -> Column:
        """As above, for candidates that also have n_leaves and n_required."""
        age = F.col("now") - F.col("first_seen")
        ratio = F.col("n_required") / F.nullif(F.col("n_leaves"), F.lit(0))
        return (
            F.when(F.col("samples") < self.min_samples, "too_few_samples").when(age < self.min_age_ms, "too_young")
            .when(F.col("n_leaves") == 0, "no_leaves").when(F.col("n_required") < self.min_required, "too_few_required")
            .when(ratio + self.slack < self.min_ratio, "ratio_too_low")
        )


def promotable(candidates: DataFrame, policy: AutoPromotePolicy, allowed: list[str], per_tick: int) -> DataFrame:
    """Candidates of allowed sources that the policy passes, at most ``per_tick``, oldest first."""
    fit = candidates.where(F.col("source").isin(*allowed) & (F.col("state") == "provisional")).withColumn("reason", policy.reason())
    return fit.where("reason is null").drop("reason").orderBy("first_seen", "candidate").limit(per_tick)


def rollup(observations: DataFrame) -> DataFrame:
    """Candidates from observations (candidate, source, at)."""
    return observations.groupBy("candidate").agg(F.min("source").alias("source"), F.count("*").alias("samples"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def keep_newest(rows: DataFrame, by: str, order: Column, most: int) -> DataFrame:
    """The newest ``most`` rows of each group, as a bounded stream of evidence keeps."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("__n") <= most).drop("__n")


def reduced_fingerprints(profiles: DataFrame, documents: DataFrame, by: str, tags: IdentityTags = DEFAULT_TAGS) -> DataFrame:
    """(by, place, removed, fingerprint): the generalized fingerprint of each profile at place 0, then those with one top-level field less, by key, if it has two or more; ``documents`` has (by, n)."""
    ship(profiles.sparkSession)
    rows = profiles.join(documents, by).select(by, "path", "n", *profile.TYPES)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        paths = {p: tuple(map(int, c)) for p, c in zip(pdf["path"], pdf[list(profile.TYPES)].to_numpy(), strict=True)}
        n = int(pdf["n"].iloc[0])
        keys = sorted((shapes.unescape(p[1:]), p) for p in paths if p.count("/") == 1 and p != "/~*")
        out = [(key[0], 0, None, profile.fingerprint(shapes.generalized(paths, n), tags))]
        for i, (name, top) in enumerate(keys if len(keys) >= 2 else (), 1):
            rest = {p: c for p, c in paths.items() if p != top and not p.startswith(f"{top}/")}
            out.append((key[0], i, name, profile.fingerprint(shapes.generalized(rest, n), tags)))
        return pd.DataFrame(out, columns=[by, "place", "removed", "fingerprint"])

    kind = profiles.schema[by].dataType.simpleString()
    return rows.groupBy(by).applyInPandas(run, f"{by} {kind}, place long, removed string, fingerprint string")


def variants(identified: DataFrame, by: str) -> DataFrame:
    """(by, bucket, fp) of the concrete shapes that records of a candidate have."""
    return identified.where("fp is not null").select(by, "bucket", "fp").distinct()


@dataclass
class Promotion:
    """What a promotion writes."""

    schemas: DataFrame  # schema_id, family_id, canonical, version, bucket, simhash, source, candidate
    index: DataFrame  # bucket, fp, schema_id
    values: DataFrame  # schema_id, path, present, denom, optional, mask
    aliases: DataFrame  # candidate, schema_id
    candidates: DataFrame  # as given, with those promoted staged
    audit: DataFrame  # candidate, schema_id, version, outcome


class Frozen(Exception):
    """The store is not healthy: tagging goes on, promotions wait."""


def promote(candidates: DataFrame, profiles: DataFrame, concrete: DataFrame, published: DataFrame, aliases: DataFrame, healthy: bool = True, tags: IdentityTags = DEFAULT_TAGS) -> Promotion:
    """Publishes the provisional ones of candidates (candidate, source, family_id, order, state) as immutable schemas; one writer at a time.

    ``profiles`` are the candidates' (candidate, path, ...), ``concrete`` their shapes (candidate, bucket, fp), ``published`` the
    registry (schema_id, family_id, canonical, version) and ``aliases`` what earlier candidates became. A schema's id is its generalized
    fingerprint, so a candidate of known content gets the schema that is there, with its version. A candidate that an alias
    already leads elsewhere raises, as does other content under a known id.
    """
    if not healthy:
        raise Frozen
    own = profiles.join(candidates.where("state = 'provisional'").select("candidate"), "candidate", "left_semi")
    docs = own.where("path = ''").select("candidate", F.col("present").alias("n"))
    made = profile.generalized(own, docs, "candidate", tags).join(profile.summary(own, "candidate"), "candidate")
    drafts = made.join(candidates, "candidate").select(F.col("fingerprint").alias("schema_id"), "family_id", "canonical", "order", "candidate", "source", "simhash", bucket_key(F.col("n_fields"), F.col("depth"), F.col("keys")).alias("bucket"))
    clash = drafts.select("candidate", "schema_id").join(aliases.select("candidate", F.col("schema_id").alias("was")), "candidate").where("schema_id <> was")
    if row := clash.first():
        raise ValueError(f"candidate {row['candidate']} is schema {row['was']} already")
    whole = registry.publish(published, drafts)
    by = drafts.join(whole.select("schema_id", "version", F.col("family_id").alias("family")), "schema_id")
    schemas = by.select("schema_id", F.col("family").alias("family_id"), "canonical", "version", "bucket", "simhash", "source", "candidate")
    shapes_of = concrete.join(by.select("candidate", "schema_id"), "candidate").select("bucket", "fp", "schema_id")
    found = profile.leaves(profile.with_denominators(own, "candidate"), "candidate").join(by.select("candidate", "schema_id"), "candidate")
    now = by.select("candidate", "schema_id")
    audit = by.join(published.select("schema_id", F.lit(True).alias("__old")), "schema_id", "left").select("candidate", "schema_id", "version", F.when(F.col("__old"), "known").otherwise("published").alias("outcome"))
    staged = candidates.join(now.select("candidate", F.lit(True).alias("__done")), "candidate", "left").withColumn("state", F.when(F.col("__done"), "staged").otherwise(F.col("state"))).drop("__done")
    return Promotion(schemas, registry.variant_index(by.select("bucket", F.col("schema_id").alias("fp"), "schema_id"), shapes_of), found.select("schema_id", "path", "present", "denom", "optional", "mask"), aliases.select("candidate", "schema_id").unionByName(now).distinct(), staged, audit)


def apply_trusted(verdicts: DataFrame, candidates: DataFrame, profiles: DataFrame, concrete: DataFrame, published: DataFrame, aliases: DataFrame, healthy: bool = True) -> Promotion:
    """Promotes the candidates whose verdict (candidate, verdict, family_id) is to apply into the family that they match; all others stay as they are."""
    fit = verdicts.where("verdict = 'apply' and family_id is not null").select("candidate", F.col("family_id").alias("__family")).distinct()
    matched = candidates.join(fit, "candidate").withColumn("family_id", F.col("__family")).drop("__family")
    return promote(matched, profiles, concrete, published, aliases, healthy)


def listed(candidates: DataFrame) -> DataFrame:
    """(state, candidate): the listing by state, made anew from the records; rejected ones are in none."""
    return candidates.where(F.col("state").isin("provisional", "staged")).select("state", "candidate").distinct()


def fold(fingerprints: list[list[str]], ids: list[str]) -> list[str]:
    """Clusters of observations in order: the first known fingerprint decides, and all then point there."""
    known: dict[str, str] = {}
    out = []
    for fps, own in zip(fingerprints, ids, strict=True):
        target = next((known[f] for f in fps if f in known), own)
        known.update(dict.fromkeys(fps, target))
        out.append(target)
    return out


def cluster(observations: DataFrame) -> DataFrame:
    """(source, seq, cluster) of distinct shapes (source, seq, id, fps) in the order of seq.

    The order of arrival decides, so a source is folded by one task; only distinct shapes reach it,
    of which a source has few however many records it sends.
    """
    first = observations.groupBy("source", "id").agg(F.min("seq").alias("seq"), F.min_by("fps", "seq").alias("fps"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pd.DataFrame({"source": key[0], "id": pdf["id"], "cluster": fold([list(f) for f in pdf["fps"]], list(pdf["id"]))})

    folded = first.groupBy("source").applyInPandas(run, "source string, id string, cluster string")
    return observations.select("source", "seq", "id").join(folded, ["source", "id"]).select("source", "seq", "cluster")


# Field names and the canonical field that each pattern stands for; the first match counts.
FIELD_RULES = [
    (r"(^|_)(lat|latitude)($|_)", "cfid_latitude"),
    (r"(^|_)(lon|lng|longitude)($|_)", "cfid_longitude"),
    (r"time|date|dtime|_seen|generated|created|publish|modified|last_contact|captured|updated", "cfid_timestamp"),
    (r"price|cost|_dph|dph_|marketprice|rce_pln|_pln|retail|spot", "cfid_price"),
    (r"(^|_)currency($|_)", "cfid_currency"),
    (r"region|zone|country|armregion|bzn|geoloc|pricearea|(^|_)state($|_)", "cfid_region"),
    (r"carbon|co2|emission|taux", "cfid_carbon"),
    (r"power|generation|_gen|_mw|demand", "cfid_power"),
    (r"^unit$", "cfid_unit"),
    (r"status|rentable|on_ground|verified", "cfid_status"),
    (r"count|downloads|pullcount|upvotes|votes", "cfid_count"),
    (r"name|label|title|displayname|longname|shortname|stacja", "cfid_name"),
    (r"value|measurement", "cfid_value"),
]


def canonical_field(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(low.rlike(p), c) for p, c in FIELD_RULES])


def name_problem(name: Column) -> Column:
    """Why a name cannot be given to a schema; null if it can."""
    bare = F.btrim(name)
    return (
        F.when(bare == "", "empty").when(F.length(bare) > 60, "too_long")
        .when(bare.rlike(r"\p{Cntrl}"), "control_character").when(~bare.rlike(r"[\p{L}\p{N}]"), "no_letter_or_digit")
    )


def name_to_keep(names: DataFrame) -> DataFrame:
    """(schema_id, name, by): a person's name over others, then the latest (schema_id, name, by, at)."""
    rank = F.struct((F.col("by") == "human").alias("h"), F.col("at"), F.col("name"))
    return names.groupBy("schema_id").agg(F.max_by(F.struct("name", "by"), rank).alias("k")).select("schema_id", "k.name", "k.by")


def within_novelty(candidates: DataFrame, per_minute: int = 10) -> DataFrame:
    """Candidates (candidate, source, first_seen in ms) that a source may start: the first few of each minute."""
    minute = F.floor(F.col("first_seen") / 60_000)
    order = W.partitionBy("source", minute).orderBy("first_seen", "candidate")
    return candidates.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_minute).drop("__n")


def next_state(state: Column, wanted: Column) -> Column:
    """The state of a candidate after a request: rejected is final, staging needs a provisional one, unknown ones stay unknown."""
    return (
        F.when(state.isNull(), "not_found").when(state == "rejected", "rejected")
        .when(wanted == "rejected", "rejected").when((wanted == "staged") & (state == "provisional"), "staged").otherwise(state)
    )


def with_source(schemas: DataFrame, candidates: DataFrame) -> DataFrame:
    """Schemas with a source: their own, or that of the candidate they came from."""
    known = candidates.select("candidate", F.col("source").alias("__source"))
    return schemas.join(known, "candidate", "left").withColumn("source", F.coalesce("source", "__source")).drop("__source")


def unexpired(rows: DataFrame, at: str, now: Column, days: int = 7) -> DataFrame:
    return rows.where(now - F.col(at) < days * 86_400_000)
