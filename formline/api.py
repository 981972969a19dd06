"""Questions that a client asks, as functions of the registry's tables that return DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import annotate, lifecycle, registry, semantic, umbrella


@dataclass
class Catalog:
    """The tables: schemas (schema_id, family_id, canonical, version, simhash as bigint, source), candidates
    (candidate, source, samples, first_seen, last_seen, state), profiles (schema_id, path, ...), revisions
    (schema_id, revision, sem_id), features (schema_id, feature, kind), names, samples (candidate, at, document),
    aliases (candidate, schema_id), umbrellas (umbrella_id, state, ...), bindings (umbrella_id, schema_id, target, path).
    """

    schemas: DataFrame
    candidates: DataFrame
    profiles: DataFrame
    revisions: DataFrame
    features: DataFrame
    names: DataFrame
    samples: DataFrame
    aliases: DataFrame
    umbrellas: DataFrame
    bindings: DataFrame

    def list_schemas(self, after: str | None = None, size: int = 100) -> DataFrame:
        return registry.page(self.schemas, "schema_id", after, size)

    def schema(self, schema_id: str) -> DataFrame:
        """A schema by its id, or by that of the candidate it came from."""
        asked = registry.resolve_alias(self.schemas.sparkSession.createDataFrame([(schema_id,)], "id string"), self.aliases.select("candidate", "schema_id"))
        return self.schemas.join(asked.select(F.col("resolved").alias("schema_id")), "schema_id")

    def name(self, schema_id: str) -> DataFrame:
        return lifecycle.name_to_keep(self.names.where(F.col("schema_id") == schema_id))

    def value_profile(self, schema_id: str) -> DataFrame:
        return self.profiles.where(F.col("schema_id") == schema_id)

    def annotation(self, schema_id: str) -> DataFrame:
        return semantic.active_revisions(self.revisions.where(F.col("schema_id") == schema_id))

    def annotation_history(self, schema_id: str) -> DataFrame:
        return self.revisions.where(F.col("schema_id") == schema_id).orderBy(F.desc("revision"))

    def schemas_meaning(self, sem_id: str) -> DataFrame:
        return semantic.active_revisions(self.revisions).where(F.col("sem_id") == sem_id).select("schema_id")

    def similar_by_meaning(self, schema_id: str, k: int = 10) -> DataFrame:
        """Neighbours by shared features, the strongest evidence first."""
        s = semantic.signature(self.features)
        return semantic.nearest(s, s.where(F.col("schema_id") == schema_id), k)

    def similar_by_structure(self, schema_id: str, radius: int = 8, k: int = 50) -> DataFrame:
        """The nearest sketches of others; one is compared with all."""
        known = self.schemas.where("simhash is not null").select("schema_id", "simhash")
        own = known.where(F.col("schema_id") == schema_id).limit(1).select(F.col("schema_id").alias("id"), F.col("simhash").alias("__x"))
        far = F.bit_count(F.col("simhash").bitwiseXOR(F.col("__x")))
        found = known.join(F.broadcast(own), F.col("schema_id") != F.col("id")).select("id", F.col("schema_id").alias("other"), far.alias("hamming"))
        return found.where(F.col("hamming") <= radius).orderBy("hamming", "other").limit(k)

    def families(self) -> DataFrame:
        return registry.families(self.schemas)

    def family_versions(self, family_id: str) -> DataFrame:
        return self.schemas.where(F.col("family_id") == family_id).select("version", "schema_id").orderBy("version")

    def list_candidates(self, state: str = "provisional", after: str | None = None, size: int = 100) -> DataFrame:
        if state not in ("provisional", "staged"):
            raise ValueError("candidates are listed by provisional or staged")
        return registry.page(self.candidates.where(F.col("state") == state), "candidate", after, size)

    def candidate_samples(self, candidate: str, most: int = 20) -> DataFrame:
        return lifecycle.keep_newest(self.samples.where(F.col("candidate") == candidate), "candidate", F.desc("at"), most)

    def promotion(self, candidate: str, now: int, policy: lifecycle.PromotionPolicy = lifecycle.PromotionPolicy()) -> DataFrame:
        """Why a candidate cannot be promoted now; a null reason means it can."""
        return self.candidates.where(F.col("candidate") == candidate).withColumn("now", F.lit(now)).select("candidate", policy.reason().alias("reason"))

    def sources(self) -> DataFrame:
        """Sources with the last time any of their candidates was seen, in whatever state."""
        return self.candidates.groupBy("source").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count("*").alias("n"))

    def list_umbrellas(self, state: str | None = None) -> DataFrame:
        return self.umbrellas if state is None else self.umbrellas.where(F.col("state") == state)

    def lineage(self, umbrella_id: str) -> DataFrame:
        """Target fields of an umbrella with the schemas and paths that they come from, and what those hold."""
        own = self.bindings.where(F.col("umbrella_id") == umbrella_id)
        return own.join(self.profiles, ["schema_id", "path"], "left").groupBy("target").agg(F.sort_array(F.collect_list(F.struct("schema_id", "path", "present"))).alias("comes_from"))

    def field_lineage(self, umbrella_id: str, target: str) -> DataFrame:
        """Where one target field comes from, a row for each schema."""
        own = self.bindings.where((F.col("umbrella_id") == umbrella_id) & (F.col("target") == target))
        return own.join(self.profiles, ["schema_id", "path"], "left").select("schema_id", "path", "present").orderBy("schema_id", "path")

    def transforms(self, umbrella_id: str) -> DataFrame:
        return self.bindings.where(F.col("umbrella_id") == umbrella_id).orderBy("schema_id", "target")

    def value_profile_of(self, family_id: str, version: int) -> DataFrame:
        known = self.schemas.where((F.col("family_id") == family_id) & (F.col("version") == version)).select("schema_id")
        return self.profiles.join(known, "schema_id", "left_semi")

    # What writes gives the new rows or outcomes, for one writer to append; nothing is changed in place.

    def rename(self, schema_id: str, name: str, by: str, at: int) -> DataFrame:
        """The names with one more; a name that cannot be given raises."""
        row = self.names.sparkSession.createDataFrame([(schema_id, name, by, at)], "schema_id string, name string, by string, at long")
        if problem := row.select(lifecycle.name_problem(F.col("name"))).first()[0]:
            raise ValueError(problem)
        return self.names.unionByName(row)

    def revise(self, proposed: DataFrame) -> DataFrame:
        """Outcomes of proposed annotations (schema_id, sem_id, etag, reason)."""
        return annotate.revise(self.revisions, proposed)

    def revised(self, proposed: DataFrame) -> DataFrame:
        """The revisions with those that are accepted, numbered on."""
        fine = self.revise(proposed).where("outcome in ('first', 'appended')").select("schema_id", "sem_id")
        last = self.revisions.groupBy("schema_id").agg(F.max("revision").alias("__last"))
        return self.revisions.unionByName(fine.join(last, "schema_id", "left").select("schema_id", (F.coalesce("__last", F.lit(0)) + 1).cast("long").alias("revision"), "sem_id"))

    def request(self, candidate: str, wanted: str) -> str:
        """The state of a candidate after a request to stage or reject it."""
        asked = self.candidates.sparkSession.createDataFrame([(candidate,)], "candidate string")
        return asked.join(self.candidates, "candidate", "left").select(lifecycle.next_state(F.col("state"), F.lit(wanted))).first()[0]

    def reindexed_candidates(self) -> DataFrame:
        return lifecycle.listed(self.candidates)

    def reconciled_sources(self, of: DataFrame) -> DataFrame:
        """Schemas with the source of the candidate they came from, where they have none; ``of`` has (schema_id, candidate)."""
        return lifecycle.with_source(self.schemas.join(of, "schema_id", "left"), self.candidates)

    def told(self, events: DataFrame) -> DataFrame:
        """Classified events with family and samples, as a client of the stream reads them."""
        return registry.enriched(events, self.schemas, self.candidates)

    def propose_umbrellas(self, fields: DataFrame, verified: DataFrame) -> DataFrame:
        members = self.schemas.select("schema_id", semantic.cluster_of(F.col("source")).alias("cluster"))
        return umbrella.proposals(fields, members, verified)

    def decide_umbrella(self, proposed: DataFrame, signature: str, wanted: str, reason: str) -> str:
        asked = proposed.sparkSession.createDataFrame([(signature, wanted, reason)], "signature string, wanted string, reason string")
        return umbrella.decide(proposed, asked).first()["outcome"]
