"""The semantic layer: signatures, their similarity, neighbours, the domain gate, drift and collisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Weights of feature classes.
CLASS_WEIGHTS = {"event": 24, "field": 12, "field_idns": 10, "field_unit": 8, "idns": 6, "unit": 4, "field_enum": 4, "enum_meaning": 3, "field_temporal": 3, "temporal": 1}
MAX_COUNT = 4
IDF_MAX, IDF_MIN_POPULATION = 16, 32

# Namespaces of sources and the cluster of each one's domain.
CLUSTERS = {
    "compute": "tech", "ai": "tech", "registry": "tech", "hw": "tech", "energy": "energy", "carbon": "energy", "grid": "energy",
    "geo": "geo", "weather": "geo", "env": "geo", "space": "geo", "civic": "civic", "kg": "civic", "transit": "transit", "firehose": "social",
}


def class_weight(kind: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, w in CLASS_WEIGHTS.items() for x in (F.lit(k), F.lit(w))]), kind)


def idf_multiplier(n: Column, df: Column) -> Column:
    """Integer: 16 in small populations or for unseen features, 0 for those of half of them, else the log2 of n / df, by bits."""
    ratio = F.floor(n / F.greatest(df, F.lit(1)))
    return F.when((n < IDF_MIN_POPULATION) | (df == 0), IDF_MAX).when(ratio < 2, 0).otherwise(F.least(F.length(F.bin(ratio)) - 1, F.lit(IDF_MAX))).cast("long")


def signature(features: DataFrame) -> DataFrame:
    """(schema_id, feature, kind, count) with counts of 4 at most."""
    return features.groupBy("schema_id", "feature", "kind").agg(F.least(F.count("*"), F.lit(MAX_COUNT)).alias("count"))


def idf(signatures: DataFrame) -> DataFrame:
    """(feature, idf) over the schemas that have a signature."""
    n = signatures.select("schema_id").distinct().agg(F.count("*").alias("n"))
    df = signatures.groupBy("feature").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("feature", idf_multiplier(F.col("n"), F.col("df")).alias("idf"))


def weighted(signatures: DataFrame, idfs: DataFrame) -> DataFrame:
    return signatures.join(idfs, "feature").withColumn("w", class_weight(F.col("kind")) * F.col("idf"))


#: Schemas of a feature that one row pairs with the rest; longer lists are dealt out in steps of so many.
STEP = 256
#: So many masses are broadcast; more are joined by shuffles.
MAX_BROADCAST = 2_000_000


def _postings(signatures: DataFrame, idfs: DataFrame | None, schemas: int) -> DataFrame:
    """(idf, p): the schemas (schema_id, w, c) of each feature with weight, in order and one row a feature; w is still to be multiplied by idf."""
    rows = signatures.where("feature is not null").select("feature", F.struct("schema_id", class_weight(F.col("kind")).cast("long").alias("w"), F.col("count").cast("long").alias("c")).alias("e"))
    by = rows.repartition("feature").groupBy("feature").agg(F.count("*").alias("df"), F.collect_list(F.when(F.col("e.schema_id").isNotNull() & (F.col("e.w") > 0), F.col("e"))).alias("p"))
    by = by.withColumn("idf", idf_multiplier(F.lit(schemas), F.col("df"))) if idfs is None else by.join(idfs.select("feature", "idf"), "feature")
    return by.where("idf > 0 and size(p) > 0").select("idf", F.sort_array("p").alias("p"))


def similarities(signatures: DataFrame, idfs: DataFrame | None = None, schemas: int | None = None) -> DataFrame:
    """(a, b, num, den) of pairs that share a feature with weight: exact integers of the weighted Jaccard.

    den = sum of both less num, so only shared features are paired. Features of half the schemas or more have no weight.
    A pair is counted once, from its lesser id, and told both ways. What is shuffled is, for each feature of a schema, the list of the
    greater ids that share it, dealt by the schema: pairs are made and summed after that, and are never shuffled themselves.
    Without ``idfs`` they are those of the signatures; ``schemas`` is how many have one, and is counted if not given.
    """
    if schemas is None:
        schemas = signatures.select("schema_id").distinct().count()
    lists = _postings(signatures, idfs, schemas)
    mass = lists.select("idf", F.explode("p").alias("e")).groupBy(F.col("e.schema_id").alias("schema_id")).agg(F.sum(F.col("e.w") * F.col("idf") * F.col("e.c")).alias("mass"))
    mass = F.broadcast(mass) if schemas <= MAX_BROADCAST else mass

    # Weights that are alike in a list, and counts of one, stay out of the shuffle.
    flat = lists.select("idf", F.col("p.schema_id").alias("ids"), F.when(F.array_max("p.w") > F.array_min("p.w"), F.col("p.w")).alias("ws"), F.when(F.array_max("p.c") > 1, F.col("p.c")).alias("cs"), F.element_at("p.w", 1).alias("w"))
    size = F.size("ids")
    short = flat.where(size <= STEP).withColumn("start", F.lit(0))
    steps = flat.where(size > STEP).withColumn("start", F.explode(F.sequence(F.lit(0), size - 1, F.lit(STEP))))
    rest = lambda c: F.slice(c, F.col("start") + 1, size).alias(c)
    dealt = short.unionByName(steps.select("idf", rest("ids"), rest("ws"), rest("cs"), "w", "start").repartition(F.hash("start", F.element_at("ids", 1))))
    each = dealt.select("*", F.posexplode(F.slice("ids", 1, STEP)).alias("i", "a"))
    tail = lambda c: F.slice(c, F.col("i") + 2, size).alias(c)
    sent = each.where(F.col("i") + 1 < size).select("a", "idf", F.coalesce(F.get("ws", F.col("i")), F.col("w")).alias("w"), F.coalesce(F.get("cs", F.col("i")), F.lit(1)).alias("c"), tail("ids"), tail("ws"), tail("cs"))

    shared = sent.repartition("a").select("a", "idf", "w", "c", "ws", "cs", F.posexplode("ids").alias("i", "b")).where("a < b")
    least = F.least("c", F.coalesce(F.get("cs", F.col("i")), F.lit(1))) * F.col("idf")
    num = shared.groupBy("a", "b").agg(F.sum(F.col("w") * least).alias("num"), F.sum(F.coalesce(F.get("ws", F.col("i")), F.col("w")) * least).alias("back"))
    both = num.join(mass.select(F.col("schema_id").alias("a"), F.col("mass").alias("__ma")), "a").join(mass.select(F.col("schema_id").alias("b"), F.col("mass").alias("__mb")), "b")
    told = lambda a, b, n: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(n).alias("num"), (F.col("__ma") + F.col("__mb") - F.col(n)).alias("den"))
    return both.select(F.inline(F.array(told("a", "b", "num"), told("b", "a", "back"))))


def ratio_text(num: Column, den: Column) -> Column:
    """A fraction as text with six digits, truncated."""
    micros = F.floor(num.cast("decimal(20,0)") * 1_000_000 / den.cast("decimal(20,0)")).cast("long")
    whole = F.floor(micros / 1_000_000).cast("long")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((micros - whole * 1_000_000).cast("string"), 6, "0"))


def strength(same_event: Column, events_differ: Column, shared_anchors: Column, coverage: Column, namespaces: Column, other_class: Column, weak: Column) -> Column:
    """Strong, medium, weak or insufficient evidence that two schemas mean the same."""
    strong = same_event | ((shared_anchors >= 2) & (coverage >= 0.5))
    medium = (shared_anchors >= 1) | (namespaces & other_class)
    return F.when(strong & ~events_differ, "strong").when(strong | medium, "medium").when(weak, "weak").otherwise("insufficient")


def neighbours(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k best others of each schema from (a, b, num, den, strength, anchors): by strength, exact score, anchors, id."""
    level = F.element_at(F.create_map(F.lit("strong"), F.lit(3), F.lit("medium"), F.lit(2), F.lit("weak"), F.lit(1)), F.col("strength"))
    exact = F.col("num").cast("decimal(20,0)") / F.col("den").cast("decimal(20,0)")
    order = W.partitionBy("a").orderBy(F.desc(level), F.desc(exact), F.desc("anchors"), "b")
    fit = scored.where("strength <> 'insufficient' and den > 0")
    return fit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cluster_of(source: Column) -> Column:
    """The cluster of a source ``events.<namespace>.<collector>``; null if unknown."""
    space = F.regexp_extract(source, r"^events\.([^.]*)", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in CLUSTERS.items() for x in kv]), space)


def domain_gate(a: Column, b: Column) -> Column:
    """A veto only if both clusters are known and differ."""
    x, y = cluster_of(a), cluster_of(b)
    return F.when(x != y, "veto_proven_disjoint").otherwise("keep")


def structural_relation(paths_a: DataFrame, paths_b: DataFrame, key: str) -> DataFrame:
    """(key, relation) from (key, path, types): compatible if no shared path differs, else whether only types changed."""
    both = paths_a.withColumnRenamed("types", "__ta").join(paths_b.withColumnRenamed("types", "__tb"), [key, "path"], "full")
    shared = F.col("__ta").isNotNull() & F.col("__tb").isNotNull()
    differ, same_set = F.bool_or(shared & (F.col("__ta") != F.col("__tb"))), F.bool_and(shared)
    return both.groupBy(key).agg(F.when(~differ, "compatible").when(same_set, "identical_paths_changed_types").otherwise("incompatible").alias("relation"))


def collisions(annotated: DataFrame) -> DataFrame:
    """(sem_id, a, b) of schemas with one meaning, each pair once; from (sem_id, schema_id)."""
    other = annotated.select("sem_id", F.col("schema_id").alias("b"))
    return annotated.withColumnRenamed("schema_id", "a").join(other, "sem_id").where("a < b").select("sem_id", "a", "b")


def colliding(annotated: DataFrame) -> DataFrame:
    """(sem_id, a, b, strength) of schemas with one meaning, each pair once; from (sem_id, schema_id, coverage, event).

    What is compared goes along to the meaning, so pairs are not shuffled to fetch it.
    """
    laid = annotated.select("sem_id", "schema_id", "coverage", F.col("event").isNotNull().alias("has")).repartition("sem_id")
    other = laid.select("sem_id", F.col("schema_id").alias("b"), F.col("coverage").alias("__c"))
    pairs = laid.withColumnRenamed("schema_id", "a").join(other, "sem_id").where("a < b")
    return pairs.select("sem_id", "a", "b", collision_strength(F.col("has"), F.col("coverage"), F.col("__c")).alias("strength"))


def collision_strength(has_event: Column, coverage_a: Column, coverage_b: Column) -> Column:
    least = F.least(coverage_a, coverage_b)
    return F.when(has_event & (least >= 0.8), "strong").when(has_event & (least > 0), "medium").otherwise("weak")


def active_revisions(revisions: DataFrame) -> DataFrame:
    """The last revision of each schema (schema_id, revision, sem_id, recorded_at)."""
    return revisions.groupBy("schema_id").agg(F.max_by("sem_id", "revision").alias("sem_id"), F.max("revision").alias("revision"), F.count("*").alias("n_revisions"))


#: Canonical fields that say too little to anchor a match.
GENERIC_FIELDS = ("cfid_timestamp", "cfid_name", "cfid_status", "cfid_count", "cfid_value")
#: A field that fewer schemas share than this idf says anchors a pair.
ANCHOR_IDF = 2
MAX_CANDIDATES = 20_000


def features(annotations: DataFrame, events: DataFrame) -> DataFrame:
    """(schema_id, feature, kind), a row for each assertion, from annotated fields (schema_id, cfid, namespace, unit, temporal, enums) and (schema_id, event).

    ``enums`` is an array of vocabulary:code. A field's compounds bear its canonical id; without one only its parts count. No
    path or name takes part.
    """
    has = lambda *c: reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in c])
    one = lambda kind, when, *parts: F.when(when, F.struct(F.lit(kind).alias("kind"), F.concat_ws("\0", F.lit(kind), *parts).alias("feature")))
    single = [
        one("field", has("cfid"), "cfid"), one("field_idns", has("cfid", "namespace"), "cfid", "namespace"), one("idns", has("namespace"), "namespace"),
        one("field_unit", has("cfid", "unit"), "cfid", "unit"), one("unit", has("unit"), "unit"),
        one("field_temporal", has("cfid", "temporal"), "cfid", "temporal"), one("temporal", has("temporal"), "temporal"),
    ]
    meaning = F.transform(F.coalesce("enums", F.array().cast("array<string>")), lambda e: F.struct(F.lit("enum_meaning").alias("kind"), F.concat_ws("\0", F.lit("enum_meaning"), e).alias("feature")))
    bound = F.transform(F.when(has("cfid"), F.coalesce("enums", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), lambda e: F.struct(F.lit("field_enum").alias("kind"), F.concat_ws("\0", F.lit("field_enum"), "cfid", e).alias("feature")))
    said = annotations.select("schema_id", F.explode(F.concat(F.array_compact(F.array(*single)), meaning, bound)).alias("f")).select("schema_id", "f.feature", "f.kind")
    event = events.where("event is not null").select("schema_id", F.concat_ws("\0", F.lit("event"), "event").alias("feature"), F.lit("event").alias("kind"))
    return said.unionByName(event)


def anchors(signatures: DataFrame, generic: tuple[str, ...] = GENERIC_FIELDS) -> DataFrame:
    """(schema_id, anchored): has an event, a namespace, or a field that is not on the stop list, however common it is."""
    telling = (F.col("kind") == "field") & ~F.split_part("feature", F.lit("\0"), F.lit(2)).isin(*generic)
    return signatures.groupBy("schema_id").agg(F.bool_or(F.col("kind").isin("event", "idns") | telling).alias("anchored"))


def strengths(pairs: DataFrame, signatures: DataFrame, idfs: DataFrame, generic: tuple[str, ...] = GENERIC_FIELDS) -> DataFrame:
    """``pairs`` (a, b) with ``strength`` and ``shared_anchors``, from the schemas' signatures (schema_id, feature, kind, count)."""
    s = signatures.join(idfs, "feature")
    is_anchor = (F.col("kind") == "field") & ~F.split_part("feature", F.lit("\0"), F.lit(2)).isin(*generic) & (F.col("idf") >= ANCHOR_IDF)
    s = s.select("schema_id", "feature", "kind", is_anchor.alias("anchor"))
    own = s.groupBy("schema_id").agg(F.count_if("anchor").alias("n"), F.max(F.when(F.col("kind") == "event", F.col("feature"))).alias("event"))
    own = own.join(anchors(signatures, generic), "schema_id")
    side = lambda n: own.select(F.col("schema_id").alias(n), F.col("n").alias(f"__n{n}"), F.col("event").alias(f"__e{n}"), F.col("anchored").alias(f"__h{n}"))
    kinds = lambda *k: F.count_if(F.col("kind").isin(*k))
    both = pairs.join(s.withColumnRenamed("schema_id", "a"), "a").join(s.select(F.col("schema_id").alias("b"), "feature"), ["b", "feature"])
    shared = both.groupBy("a", "b").agg(
        F.count_if("anchor").alias("shared_anchors"), (kinds("idns") > 0).alias("__ns"), (F.count_if(F.col("kind") != "idns") > 0).alias("__other"),
        (kinds("unit", "temporal", "enum_meaning") > 0).alias("__weak"),
    )
    rows = pairs.join(shared, ["a", "b"], "left").join(side("a"), "a").join(side("b"), "b")
    n, least = F.coalesce("shared_anchors", F.lit(0)), F.least("__na", "__nb")
    # Half of the fields of the side that has fewer are enough; without any there is no coverage.
    coverage = F.when((least > 0) & (n * 2 >= least), 1.0).otherwise(0.0)
    level = strength(F.coalesce(F.col("__ea") == F.col("__eb"), F.lit(False)), F.coalesce(F.col("__ea") != F.col("__eb"), F.lit(False)), n, coverage, F.coalesce("__ns", F.lit(False)), F.coalesce("__other", F.lit(False)), F.coalesce("__weak", F.lit(False)))
    return rows.select(*pairs.columns, F.when(F.col("__ha") & F.col("__hb"), level).otherwise("insufficient").alias("strength"), n.alias("shared_anchors"))


def nearest(signatures: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """(a, b, num, den, strength, anchors, rank): the k best others of each asked schema (schema_id), from signatures to ranks.

    Features without weight are left out, but for a schema that would have none left.
    """
    idfs = idf(signatures)
    s = signatures.join(idfs, "feature").withColumn("w", class_weight(F.col("kind")) * F.col("idf"))
    mass = s.groupBy("schema_id").agg(F.sum(F.col("w") * F.col("count")).alias("mass"))
    mine = s.join(asked.select("schema_id").distinct(), "schema_id", "left_semi")
    keeps = mine.groupBy("schema_id").agg((F.max("w") > 0).alias("__some"))
    mine = mine.join(keeps, "schema_id").where("w > 0 or not __some").select(F.col("schema_id").alias("a"), "feature", "w", "count")
    other = s.select(F.col("schema_id").alias("b"), "feature", F.col("count").alias("__c"))
    num = mine.join(other, "feature").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("w") * F.least("count", "__c")).alias("num"))
    scored = num.join(mass.select(F.col("schema_id").alias("a"), F.col("mass").alias("__ma")), "a").join(mass.select(F.col("schema_id").alias("b"), F.col("mass").alias("__mb")), "b")
    scored = scored.select("a", "b", "num", (F.col("__ma") + F.col("__mb") - F.col("num")).alias("den"))
    told = strengths(scored, signatures, idfs).withColumnRenamed("shared_anchors", "anchors")
    return neighbours(told, k)


def family_drift(versions: DataFrame, paths: DataFrame) -> DataFrame:
    """(schema_id, prior, relation, drifted): every version (schema_id, family_id, version, sem_id) against each earlier one of its family.

    ``paths`` has (schema_id, path, types). Meaning drifts where both are annotated, differently, and the structures are compatible.
    A version goes to its family with its paths as one list, so pairs are made and compared after the shuffle and are never shuffled.
    """
    whole = F.col("path").isNotNull() & F.col("types").isNotNull()
    shape = paths.where("schema_id is not null").groupBy("schema_id").agg(F.collect_set(F.when(whole, F.struct("path", "types"))).alias("e"), F.bool_or(~whole).alias("bare"))
    laid = versions.select("family_id", "schema_id", "version", "sem_id").join(shape, "schema_id", "left").repartition("family_id")
    laid = laid.select("family_id", "schema_id", "version", F.col("sem_id").alias("sem"), "e", F.array_distinct("e.path").alias("p"), F.coalesce("bare", F.lit(False)).alias("bare"))
    side = lambda n: laid.select("family_id", *[F.col(c).alias(f"{n}_{c}") for c in laid.columns[1:]])
    pairs = side("a").join(side("b"), "family_id").where("b_version < a_version")
    # Entries agree on shared paths if they share as many; where a path has types of several kinds, each is held against each.
    shared, same = F.size(F.array_intersect("a_p", "b_p")), F.size(F.array_intersect("a_e", "b_e"))
    several = (F.size("a_e") > F.size("a_p")) | (F.size("b_e") > F.size("b_p"))
    each = F.exists("a_e", lambda x: F.exists("b_e", lambda y: (x["path"] == y["path"]) & (x["types"] != y["types"])))
    differ = F.coalesce(F.when(several, each).otherwise(shared > same), F.lit(False))
    all_shared = ~F.col("a_bare") & ~F.col("b_bare") & (shared == F.size("a_p")) & (shared == F.size("b_p"))
    told = pairs.withColumn("relation", F.when(~differ, "compatible").when(all_shared, "identical_paths_changed_types").otherwise("incompatible"))
    drifted = (F.col("relation") == "compatible") & F.coalesce(F.col("a_sem") != F.col("b_sem"), F.lit(False))
    return told.select(F.col("a_schema_id").alias("schema_id"), F.col("b_schema_id").alias("prior"), "relation", drifted.alias("drifted"))


def coverage(leaves: DataFrame, annotated: DataFrame) -> DataFrame:
    """(schema_id, coverage): the annotated share of a schema's leaf paths."""
    known = annotated.select("schema_id", "path").distinct().withColumn("__a", F.lit(1))
    return leaves.join(known, ["schema_id", "path"], "left").groupBy("schema_id").agg((F.count("__a") / F.count("*")).alias("coverage"))


def candidates_of(signatures: DataFrame, schema_id, most: int = MAX_CANDIDATES) -> DataFrame:
    """Schemas that share a feature with one; too many are an error and never cut."""
    own = signatures.where(F.col("schema_id") == schema_id).select("feature").distinct()
    found = signatures.join(own, "feature").where(F.col("schema_id") != schema_id).select("schema_id").distinct()
    if found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} candidates")
    return found
