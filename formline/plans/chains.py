"""Registered queries that go the whole way: from records or annotated fields, through features, to decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import DEFAULT_TAGS, field_band
from ..functions.records import observe, parse_records
from ..operators import annotate, classify, evaluate, gates, lifecycle, profile, registry, reshape, retrieval, semantic, umbrella
from .derive import RECORDS, records, sql
from .queries import _BODIES, _GENERALIZED, _LEAVES, _SIMHASH, _SUMMARY, ORACLE_SQL, QUERIES, _known, query, with_paths

# Structure: profiles to features to the nearest families.

_JACCARD = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0 ELSE 1 - len(list_intersect({0}, {1})) * 1.0 / len(list_distinct(list_concat({0}, {1}))) END"


def _jaccard(c: str) -> str:
    return _JACCARD.format(f"x.{c}", f"y.{c}")


def _features(n: str, by: str) -> str:
    """Tables of a key's fields (f), features (v) and summary (w), each with a number."""
    body = with_paths(by).removeprefix("WITH ")
    for t in ("o", "s", "j"):
        body = body.replace(f" {t} AS (", f" {t}{n} AS (").replace(f"FROM {t} ", f"FROM {t}{n} ").replace(f"JOIN {t} p", f"JOIN {t}{n} p")
    body = body.replace("FROM s1 LEFT", f"FROM s{n} s LEFT").replace(f"FROM s{n} LEFT", f"FROM s{n} s LEFT")
    types = "list_filter([CASE WHEN t_arr > 0 THEN 'array' END, CASE WHEN t_null > 0 THEN 'null' END, CASE WHEN t_num > 0 THEN 'number' END, CASE WHEN t_obj > 0 THEN 'object' END, CASE WHEN t_str > 0 THEN 'string' END], lambda x: x IS NOT NULL)"
    having = lambda t: f"coalesce(list(path) FILTER (WHERE list_contains(ty, '{t}')), [])"
    return f"""{body}, f{n} AS (SELECT source, path, {types} AS ty, present < denom AS optional FROM j{n} WHERE path <> ''),
 v{n} AS (SELECT source, coalesce(list(path) FILTER (WHERE NOT optional), []) AS required, {having('null')} AS nullable, {having('array')} AS arrays, {having('object')} AS objects, list_distinct(flatten(list(ty))) AS kinds,
  list_distinct(list(regexp_extract(path, '[^/]*$')) FILTER (WHERE path NOT LIKE '%/~*')) AS tokens, max(length(path) - length(replace(path, '/', ''))) AS depth FROM f{n} GROUP BY 1),
 w{n} AS (SELECT source, count(*) FILTER (WHERE length(path) - length(replace(path, '/', '')) = 1 AND path NOT LIKE '%/~*') AS n_fields, max(length(path) - length(replace(path, '/', ''))) + 1 AS depth FROM s{n} GROUP BY 1)"""


def _structured(spark, sf_dir, key):
    """(id, n_fields, depth, f) of the profiles by a key."""
    seen = observe(records(spark, sf_dir).withColumn("id", key), "id")
    p = profile.profile(seen, "id")
    f = retrieval.features(profile.fields(p, "id"), "id")
    packed = f.select("id", F.struct(*[c for c in f.columns if c != "id"]).alias("f"))
    return profile.summary(p, "id").select("id", "n_fields", "depth").join(packed, "id")


_WITH_FEATURES = f"WITH {_features('1', 'source')}"


@query(f"""{_WITH_FEATURES} SELECT source, array_to_string(list_sort(required), ' ') AS required, array_to_string(list_sort(nullable), ' ') AS nullable, array_to_string(list_sort(arrays), ' ') AS arrays, array_to_string(list_sort(objects), ' ') AS objects,
 array_to_string(list_sort(kinds), ' ') AS kinds, array_to_string(list_sort(tokens), ' ') AS tokens, depth FROM v1""")
def structural_features(spark, sf_dir):
    """What retrieval compares of each source's profile."""
    f = _structured(spark, sf_dir, F.col("source"))
    listed = lambda c: F.array_join(F.sort_array(f"f.{c}"), " ").alias(c)
    return f.select(F.col("id").alias("source"), *[listed(c) for c in ("required", "nullable", "arrays", "objects", "kinds", "tokens")], "f.depth")


_BAND = "CASE WHEN {0} <= 0 THEN 0 WHEN {0} = 1 THEN 1 WHEN {0} <= 2 THEN 2 WHEN {0} <= 4 THEN 4 WHEN {0} <= 8 THEN 8 ELSE 16 END"
_QUERIES, _SCHEMAS = "concat(event_type, ':', k)", "concat(source, ':', k)"


@query(f"""WITH {_features('1', _QUERIES)}, {_features('2', _SCHEMAS).partition('), o2 AS')[1].lstrip('), ')}{_features('2', _SCHEMAS).partition('), o2 AS')[2]},
 q AS (SELECT DISTINCT source, {_BAND.format('(n_fields + x)')} AS band, depth FROM w1, (SELECT unnest([-1, 0, 1]) AS x)),
 c AS (SELECT DISTINCT q.source AS query, w2.source AS schema_id FROM q JOIN w2 ON {_BAND.format('w2.n_fields')} = q.band AND w2.depth BETWEEN greatest(q.depth - 1, 0) AND q.depth + 1),
 u AS (SELECT query, schema_id, path FROM c JOIN f1 ON f1.source = query UNION SELECT query, schema_id, path FROM c JOIN f2 ON f2.source = schema_id),
 t AS (SELECT u.query, u.schema_id, avg(CASE WHEN a.ty IS NULL OR b.ty IS NULL THEN 1.0 ELSE {_JACCARD.format('a.ty', 'b.ty')} END) AS path_type FROM u LEFT JOIN f1 a ON a.source = u.query AND a.path = u.path LEFT JOIN f2 b ON b.source = u.schema_id AND b.path = u.path GROUP BY 1, 2),
 d AS (SELECT query, schema_id, split_part(schema_id, ':', 2) AS family_id, 0.35 * path_type + 0.25 * {_jaccard('tokens')} + 0.15 * {_jaccard('required')} + 0.10 * abs(x.depth - y.depth) / greatest(x.depth, y.depth, 1)
  + 0.10 * ({_jaccard('nullable')} + {_jaccard('kinds')}) / 2 + 0.05 * ({_jaccard('arrays')} + {_jaccard('objects')}) / 2 AS distance FROM t JOIN v1 x ON x.source = query JOIN v2 y ON y.source = schema_id),
 e AS (SELECT *, round(distance, 5) AS near FROM d QUALIFY row_number() OVER (PARTITION BY query, family_id ORDER BY round(distance, 5), schema_id) = 1)
 SELECT query, family_id, schema_id, CAST(least(row_number() OVER (PARTITION BY query ORDER BY near, family_id), 3) AS INTEGER) AS rank, round(near, 4) AS distance FROM e QUALIFY row_number() OVER (PARTITION BY query ORDER BY near, family_id) <= 3""")
def structural_retrieval(spark, sf_dir):
    """Profiles by kind of event against those by source: band and depth, six distances, best schema of each family, the nearest three."""
    asked = _structured(spark, sf_dir, F.concat_ws(":", "event_type", (F.col("rec_id") % 8).cast("string"))).withColumnRenamed("id", "query")
    known = _structured(spark, sf_dir, F.concat_ws(":", "source", (F.col("rec_id") % 8).cast("string"))).withColumnRenamed("id", "schema_id")
    known = known.withColumn("family_id", F.split_part("schema_id", F.lit(":"), F.lit(2))).withColumn("version", F.lit(1)).withColumn("band", field_band(F.col("n_fields")))
    found = retrieval.retrieve(asked, known, 3).where("not tie")
    return found.select("query", "family_id", "schema_id", "rank", F.round(F.col("distance").cast("double"), 4).alias("distance"))


# Meaning: annotated fields to signatures to neighbours and drift.

#: A schema for each order, a field for each of its lines.
_ANNOTATED = """SELECT l_orderkey AS schema_id, concat('/f', CAST(l_linenumber AS STRING)) AS path, CASE WHEN p_size < 6 THEN NULL WHEN p_type = 'ECONOMY' THEN 'cfid_timestamp' ELSE concat('cfid_', replace(p_name, ' ', '_')) END AS cfid,
 CASE WHEN p_size > 44 THEN p_brand END AS namespace, CASE l_returnflag WHEN 'A' THEN 'W' WHEN 'R' THEN 'kW' END AS unit, CASE WHEN l_quantity > 45 THEN l_linestatus END AS temporal, CASE WHEN l_linenumber = 7 THEN concat('flag:', l_returnflag) END AS meaning,
 CASE WHEN l_linestatus = 'O' THEN 'integer' WHEN p_size > 48 THEN 'string' ELSE 'decimal' END AS type
 FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey"""
_EVENTS = "SELECT o_orderkey AS schema_id, CASE WHEN o_orderpriority = '5-LOW' THEN concat('ev_', o_orderstatus) END AS event FROM orders"

_SIGNATURES = f"""a AS ({_ANNOTATED}), ev AS ({_EVENTS}), p AS (SELECT schema_id, unnest(list_filter([
  CASE WHEN cfid IS NOT NULL THEN struct_pack(kind := 'field', feature := concat('field', chr(0), cfid)) END, CASE WHEN cfid IS NOT NULL AND namespace IS NOT NULL THEN struct_pack(kind := 'field_idns', feature := concat('field_idns', chr(0), cfid, chr(0), namespace)) END,
  CASE WHEN namespace IS NOT NULL THEN struct_pack(kind := 'idns', feature := concat('idns', chr(0), namespace)) END, CASE WHEN cfid IS NOT NULL AND unit IS NOT NULL THEN struct_pack(kind := 'field_unit', feature := concat('field_unit', chr(0), cfid, chr(0), unit)) END,
  CASE WHEN unit IS NOT NULL THEN struct_pack(kind := 'unit', feature := concat('unit', chr(0), unit)) END, CASE WHEN cfid IS NOT NULL AND temporal IS NOT NULL THEN struct_pack(kind := 'field_temporal', feature := concat('field_temporal', chr(0), cfid, chr(0), temporal)) END,
  CASE WHEN temporal IS NOT NULL THEN struct_pack(kind := 'temporal', feature := concat('temporal', chr(0), temporal)) END, CASE WHEN meaning IS NOT NULL THEN struct_pack(kind := 'enum_meaning', feature := concat('enum_meaning', chr(0), meaning)) END,
  CASE WHEN cfid IS NOT NULL AND meaning IS NOT NULL THEN struct_pack(kind := 'field_enum', feature := concat('field_enum', chr(0), cfid, chr(0), meaning)) END], lambda x: x IS NOT NULL)) AS f FROM a),
 r AS (SELECT schema_id, f.feature AS feature, f.kind AS kind FROM p UNION ALL SELECT schema_id, concat('event', chr(0), event), 'event' FROM ev WHERE event IS NOT NULL),
 s AS (SELECT schema_id, feature, kind, least(count(*), 4) AS c FROM r GROUP BY 1, 2, 3), n AS (SELECT count(DISTINCT schema_id) AS n FROM s),
 i AS (SELECT feature, CAST(CASE WHEN n < 32 THEN 16 WHEN n // count(*) < 2 THEN 0 ELSE least(CAST(floor(log2(n // count(*))) AS BIGINT), 16) END AS BIGINT) AS idf FROM s, n GROUP BY feature, n)"""
_CLASS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in semantic.CLASS_WEIGHTS.items()) + " END"
_GENERIC = ", ".join(f"'{x}'" for x in semantic.GENERIC_FIELDS)


def _signatures(spark, sf_dir) -> DataFrame:
    a = sql(spark, sf_dir, _ANNOTATED).withColumn("enums", F.when(F.col("meaning").isNotNull(), F.array("meaning")))
    return semantic.signature(semantic.features(a, sql(spark, sf_dir, _EVENTS)))


@query(f"WITH {_SIGNATURES} SELECT schema_id, kind, replace(feature, chr(0), '|') AS feature, c AS count FROM s")
def semantic_signatures(spark, sf_dir):
    return _signatures(spark, sf_dir).select("schema_id", "kind", F.replace("feature", F.lit("\0"), F.lit("|")).alias("feature"), "count")


@query(f"WITH {_SIGNATURES} SELECT schema_id, bool_or(kind IN ('event', 'idns') OR (kind = 'field' AND split_part(feature, chr(0), 2) NOT IN ({_GENERIC}))) AS anchored FROM s GROUP BY 1")
def semantic_anchors(spark, sf_dir):
    return semantic.anchors(_signatures(spark, sf_dir))


@query(f"""WITH {_SIGNATURES}, w AS (SELECT schema_id, s.feature, kind, c, idf, idf * {_CLASS} AS w FROM s JOIN i ON s.feature = i.feature), mass AS (SELECT schema_id, sum(w * c) AS mass FROM w GROUP BY 1),
 mine AS (SELECT * FROM w WHERE schema_id % 50 = 0 QUALIFY w > 0 OR max(w) OVER (PARTITION BY schema_id) = 0),
 num AS (SELECT x.schema_id AS a, y.schema_id AS b, sum(x.w * least(x.c, y.c)) AS num FROM mine x JOIN s y ON x.feature = y.feature AND x.schema_id <> y.schema_id GROUP BY 1, 2),
 sc AS (SELECT a, b, num, x.mass + y.mass - num AS den FROM num JOIN mass x ON x.schema_id = a JOIN mass y ON y.schema_id = b),
 an AS (SELECT *, kind = 'field' AND split_part(feature, chr(0), 2) NOT IN ({_GENERIC}) AND idf >= 2 AS anchor FROM w),
 own AS (SELECT schema_id, count(*) FILTER (WHERE anchor) AS k, max(CASE WHEN kind = 'event' THEN feature END) AS ev, bool_or(kind IN ('event', 'idns') OR (kind = 'field' AND split_part(feature, chr(0), 2) NOT IN ({_GENERIC}))) AS has FROM an GROUP BY 1),
 sh AS (SELECT sc.a, sc.b, count(*) FILTER (WHERE x.anchor) AS anchors, bool_or(x.kind = 'idns') AS ns, bool_or(x.kind <> 'idns') AS other, bool_or(x.kind IN ('unit', 'temporal', 'enum_meaning')) AS weak FROM sc JOIN an x ON x.schema_id = a JOIN an y ON y.schema_id = b AND y.feature = x.feature GROUP BY 1, 2),
 st AS (SELECT sc.*, anchors, CASE WHEN NOT (x.has AND y.has) THEN 0 WHEN (coalesce(x.ev = y.ev, false) OR (anchors >= 2 AND least(x.k, y.k) > 0 AND anchors * 2 >= least(x.k, y.k))) AND NOT coalesce(x.ev <> y.ev, false) THEN 3
  WHEN coalesce(x.ev = y.ev, false) OR (anchors >= 2 AND least(x.k, y.k) > 0 AND anchors * 2 >= least(x.k, y.k)) OR anchors >= 1 OR (ns AND other) THEN 2 WHEN weak THEN 1 ELSE 0 END AS level FROM sc JOIN sh ON sh.a = sc.a AND sh.b = sc.b JOIN own x ON x.schema_id = sc.a JOIN own y ON y.schema_id = sc.b)
 SELECT a, b, CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den, CASE level WHEN 3 THEN 'strong' WHEN 2 THEN 'medium' ELSE 'weak' END AS strength, anchors, CAST(row_number() OVER o AS INTEGER) AS rank FROM st WHERE level > 0 AND den > 0
 WINDOW o AS (PARTITION BY a ORDER BY level DESC, CAST(num AS HUGEINT) * 1000000000000000000 // CAST(den AS HUGEINT) DESC, anchors DESC, b) QUALIFY row_number() OVER o <= 10""")
def semantic_neighbors(spark, sf_dir):
    """A search: schemas with ids divisible by 50 against all, from annotations to ranks."""
    s = _signatures(spark, sf_dir)
    return semantic.nearest(s, s.where("schema_id % 50 = 0")).select("a", "b", "num", "den", "strength", "anchors", "rank")


_VERSIONS = f"""SELECT o_orderkey AS schema_id, o_custkey AS family_id, o_orderkey AS version, event AS sem_id FROM orders JOIN ({_EVENTS}) e ON e.schema_id = o_orderkey"""
_SHAPES = "SELECT l_orderkey AS schema_id, concat('/f', CAST(l_linenumber AS STRING)) AS path, min(l_returnflag) AS types FROM lineitem GROUP BY 1, 2"


@query(f"""WITH v AS ({_VERSIONS}), t AS ({_SHAPES}), p AS (SELECT x.schema_id, y.schema_id AS prior, x.sem_id AS now, y.sem_id AS was FROM v x JOIN v y ON x.family_id = y.family_id AND y.version < x.version),
 l AS (SELECT p.schema_id, prior, path, types FROM p JOIN t ON t.schema_id = p.schema_id), r AS (SELECT p.schema_id, prior, path, types FROM p JOIN t ON t.schema_id = prior),
 b AS (SELECT coalesce(l.schema_id, r.schema_id) AS schema_id, coalesce(l.prior, r.prior) AS prior, l.types AS a, r.types AS b FROM l FULL JOIN r ON l.schema_id = r.schema_id AND l.prior = r.prior AND l.path = r.path),
 d AS (SELECT schema_id, prior, CASE WHEN NOT bool_or(a IS NOT NULL AND b IS NOT NULL AND a <> b) THEN 'compatible' WHEN bool_and(a IS NOT NULL AND b IS NOT NULL) THEN 'identical_paths_changed_types' ELSE 'incompatible' END AS relation FROM b GROUP BY 1, 2)
 SELECT p.schema_id, p.prior, coalesce(relation, 'compatible') AS relation, coalesce(relation, 'compatible') = 'compatible' AND coalesce(now <> was, false) AS drifted FROM p LEFT JOIN d ON d.schema_id = p.schema_id AND d.prior = p.prior""")
def family_version_drift(spark, sf_dir):
    """Every version of a family against each earlier one: structure, and whether the meaning drifted."""
    return semantic.family_drift(sql(spark, sf_dir, _VERSIONS), sql(spark, sf_dir, _SHAPES))


@query(f"""WITH a AS ({_ANNOTATED}), c AS (SELECT schema_id, count(DISTINCT path) FILTER (WHERE cfid IS NOT NULL) * 1.0 / count(DISTINCT path) AS cov FROM a GROUP BY 1), e AS ({_EVENTS}),
 m AS (SELECT c.schema_id, cov, event, o_custkey AS sem_id FROM c JOIN e ON e.schema_id = c.schema_id JOIN orders ON o_orderkey = c.schema_id)
 SELECT x.schema_id AS a, y.schema_id AS b, CASE WHEN x.event IS NOT NULL AND least(x.cov, y.cov) >= 0.8 THEN 'strong' WHEN x.event IS NOT NULL AND least(x.cov, y.cov) > 0 THEN 'medium' ELSE 'weak' END AS strength
 FROM m x JOIN m y ON x.sem_id = y.sem_id AND x.schema_id < y.schema_id""")
def collision_strength(spark, sf_dir):
    """Schemas of one meaning, with coverage counted from their annotated leaves."""
    a = sql(spark, sf_dir, _ANNOTATED)
    leaves = a.select("schema_id", "path", F.col("cfid").isNotNull().alias("known")).repartition("schema_id").groupBy("schema_id", "path").agg(F.bool_or("known").alias("known"))
    cov = leaves.groupBy("schema_id").agg((F.count_if("known") / F.count("*")).alias("coverage"))
    rows = cov.join(sql(spark, sf_dir, _EVENTS), "schema_id").join(sql(spark, sf_dir, "SELECT o_orderkey AS schema_id, o_custkey AS sem_id FROM orders"), "schema_id")
    return semantic.colliding(rows).select("a", "b", "strength")


# Consolidation: annotated fields to verified transforms, proposals and decisions.

_TARGETS = "SELECT cfid, concat('g_', cfid) AS target, CASE WHEN bool_or(type = 'string') THEN 'string' ELSE 'decimal' END AS target_type, max(unit) AS target_unit, count(*) > 400 AS required FROM a WHERE cfid IS NOT NULL GROUP BY 1"
_RULE = "(unit, target_unit) IN (" + ", ".join(f"('{x}', '{y}')" for x, y in umbrella.CONVERSIONS) + ")"
_PAIRED = f"""a AS ({_ANNOTATED}), t AS ({_TARGETS}), p AS (SELECT a.*, target, target_type, target_unit, required, CASE WHEN unit IS NOT DISTINCT FROM target_unit AND (type = target_type OR (type = 'integer' AND target_type = 'decimal')) THEN 'exact'
  WHEN {_RULE} THEN 'quantity' END AS verdict FROM a JOIN t ON t.cfid = a.cfid),
 b AS (SELECT schema_id, path, target, CASE WHEN type <> target_type AND type = 'integer' AND target_type = 'decimal' THEN 'decimal' END AS cast_to, CASE WHEN unit IS DISTINCT FROM target_unit THEN concat(unit, '>', target_unit) END AS rule,
  CASE WHEN required THEN 'reject' ELSE 'omit' END AS on_missing, type, target_type FROM p WHERE verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY schema_id, target ORDER BY path) = 1)"""
_PROBLEMS = f"""k AS (SELECT DISTINCT schema_id FROM a WHERE cfid IS NOT NULL), x AS (SELECT schema_id, concat('type_mismatch:', target) AS problem FROM b WHERE NOT (CASE WHEN rule IS NOT NULL THEN 'decimal' ELSE coalesce(cast_to, type) END = target_type)
  UNION SELECT k.schema_id, concat('required_not_total:', target) FROM k, t WHERE required AND (k.schema_id, target) NOT IN (SELECT (schema_id, target) FROM b WHERE on_missing <> 'omit')),
 y AS (SELECT k.schema_id, coalesce(string_agg(problem, ',' ORDER BY problem), '') AS problems FROM k LEFT JOIN x ON x.schema_id = k.schema_id GROUP BY 1)"""


#: So many targets are broadcast; more are joined by shuffles.
_MAX_TARGETS = 10_000


def _fields(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A schema's annotated fields, and the target of each canonical field.

    Fields are dealt by schemas once. They are gathered whole, so that all that is asked of them reads the same shuffle.
    """
    a = sql(spark, sf_dir, _ANNOTATED)
    held = a.where("cfid is not null").select("schema_id", F.struct("path", "cfid", "type", "unit").alias("f")).repartition("schema_id").groupBy("schema_id").agg(F.collect_list("f").alias("f"))
    kept = held.select("schema_id", F.explode("f").alias("f")).select("schema_id", "f.*")
    targets = kept.groupBy("cfid").agg(F.concat(F.lit("g_"), F.first("cfid")).alias("target"), F.when(F.bool_or(F.col("type") == "string"), "string").otherwise("decimal").alias("target_type"), F.max("unit").alias("target_unit"), (F.count("*") > 400).alias("required"))
    # A target's name comes from a part's.
    few = sql(spark, sf_dir, "SELECT DISTINCT p_name FROM part").limit(_MAX_TARGETS).count() < _MAX_TARGETS
    return kept, F.broadcast(targets) if few else targets


def _transforms(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    child, targets = _fields(spark, sf_dir)
    return child, targets, umbrella.assemble(umbrella.pair_fields(child, targets))


@query(f"WITH {_PAIRED} SELECT schema_id, path, target, cast_to, rule, on_missing FROM b")
def umbrella_transforms(spark, sf_dir):
    return _transforms(spark, sf_dir)[2].withColumnRenamed("cast", "cast_to")


@query(f"WITH {_PAIRED}, {_PROBLEMS} SELECT schema_id, problems FROM y")
def umbrella_verified(spark, sf_dir):
    child, targets, bindings = _transforms(spark, sf_dir)
    return umbrella.sound(bindings, child, targets.drop("cfid")).select("schema_id", F.array_join("problems", ",").alias("problems"))


_PROPOSED = f"""{_PAIRED}, {_PROBLEMS}, g AS (SELECT schema_id, string_agg(DISTINCT concat(cfid, '=', type), '|' ORDER BY concat(cfid, '=', type)) AS signature FROM a WHERE cfid IS NOT NULL GROUP BY 1),
 m AS (SELECT o_orderkey AS schema_id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS cluster FROM orders),
 z AS (SELECT signature, count(*) AS n, count(*) FILTER (WHERE problems = '') AS n_verified, count(DISTINCT cluster) AS n_clusters FROM g JOIN y ON y.schema_id = g.schema_id LEFT JOIN m ON m.schema_id = g.schema_id GROUP BY 1 HAVING count(*) >= 2),
 q AS (SELECT *, CASE WHEN n_clusters > 1 THEN 'suppressed' WHEN n_verified < 2 THEN 'unverified' ELSE 'proposed' END AS state FROM z)"""


def _proposals(spark, sf_dir) -> DataFrame:
    child, targets, bindings = _transforms(spark, sf_dir)
    clusters = sql(spark, sf_dir, "SELECT o_orderkey AS schema_id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS cluster FROM orders")
    return umbrella.proposals(child, clusters, umbrella.sound(bindings, child, targets.drop("cfid")))


@query(f"WITH {_PROPOSED} SELECT signature, n, n_verified, n_clusters, state FROM q")
def umbrella_proposals(spark, sf_dir):
    return _proposals(spark, sf_dir).select("signature", "n", "n_verified", "n_clusters", "state")


@query(f"""WITH {_PROPOSED} SELECT signature, CASE WHEN n % 3 = 0 THEN 'reason_required' WHEN state <> 'proposed' THEN 'conflict' WHEN n % 2 = 0 THEN 'approved' ELSE 'rejected' END AS outcome FROM q UNION ALL SELECT 'nowhere', 'not_found'""")
def umbrella_decisions(spark, sf_dir):
    p = _proposals(spark, sf_dir)
    asked = p.select("signature", F.when(F.col("n") % 2 == 0, "approved").otherwise("rejected").alias("wanted"), F.when(F.col("n") % 3 == 0, " ").otherwise("why").alias("reason"))
    asked = asked.unionByName(spark.createDataFrame([("nowhere", "approved", "why")], asked.schema))
    return umbrella.decide(p, asked).select("signature", "outcome")


# Promotion: unknown records to published schemas.

_BUCKET = f"concat('formline:index:', {_BAND.format('n_fields')}, ':', depth, ':', substr(sha256(replace(keys, ',', chr(0))), 1, 8))"


def _promotion(spark, sf_dir) -> lifecycle.Promotion:
    done = classify.with_identity(records(spark, sf_dir)).where("fp is not null").withColumn("candidate", F.col("source"))
    p = profile.profile(observe(records(spark, sf_dir).withColumn("candidate", F.col("source")), "candidate"), "candidate")
    names = done.select("candidate").distinct().select("candidate", F.col("candidate").alias("source"), F.split_part("candidate", F.lit("."), F.lit(2)).alias("family_id"), F.col("candidate").alias("order"), F.lit("provisional").alias("state"))
    published = spark.createDataFrame([], "schema_id string, family_id string, canonical string, version long")
    return lifecycle.promote(names, p, lifecycle.variants(done, "candidate"), published, spark.createDataFrame([], "candidate string, schema_id string"))


_PROMOTED = f"{with_paths()}, {_BODIES}, {_GENERALIZED}, {_SIMHASH}, {_SUMMARY}, e AS (SELECT c.source, fingerprint, simhash, {_BUCKET} AS bucket, split_part(c.source, '.', 2) AS family_id FROM c JOIN x ON x.source = c.source JOIN m ON m.source = c.source)"


@query(f"""{_PROMOTED}, ff AS (SELECT fingerprint, min(source) AS first FROM e GROUP BY 1), gg AS (SELECT ff.fingerprint, e.family_id, CAST(row_number() OVER (PARTITION BY e.family_id ORDER BY first, ff.fingerprint) AS BIGINT) AS version FROM ff JOIN e ON e.fingerprint = ff.fingerprint AND e.source = first)
 SELECT e.source, e.fingerprint AS schema_id, gg.family_id, version, bucket, simhash FROM e JOIN gg ON gg.fingerprint = e.fingerprint""")
def promoted_schemas(spark, sf_dir):
    return _promotion(spark, sf_dir).schemas.select("source", "schema_id", "family_id", "version", "bucket", "simhash")


@query(f"""{_PROMOTED}, {_LEAVES} SELECT DISTINCT fingerprint AS schema_id, path, present, denom, mask FROM l JOIN e ON e.source = l.source""")
def promoted_values(spark, sf_dir):
    return _promotion(spark, sf_dir).values.select("schema_id", "path", "present", "denom", F.col("mask").cast("long").alias("mask")).distinct()


_CHILDREN = "regexp_extract(path, '[^/]*$')"


@query(f"""{with_paths()}, {_BODIES}, {_GENERALIZED}, t AS (SELECT source, path, {_CHILDREN} AS name, body FROM b1), w AS (SELECT x.source, x.name AS removed, row_number() OVER (PARTITION BY x.source ORDER BY x.name) AS place,
  (SELECT string_agg('"' || y.name || '":' || y.body, ',' ORDER BY y.name) FROM t y WHERE y.source = x.source AND y.name <> x.name) AS kids FROM t x QUALIFY count(*) OVER (PARTITION BY x.source) >= 2)
 SELECT source, 0 AS place, NULL AS removed, fingerprint FROM c UNION ALL SELECT source, place, removed, sha256(concat('{DEFAULT_TAGS.generalizer}', chr(0), '{{"gen":"{DEFAULT_TAGS.generalizer}","fields":', '{{"optional":false,"types":["object"],"children":{{', kids, '}}}}', '}}')) FROM w""")
def reduced_fingerprints(spark, sf_dir):
    """Each source's generalized fingerprint, and those with one top-level field less."""
    p = profile.profile(observe(records(spark, sf_dir), "source"), "source")
    return lifecycle.reduced_fingerprints(p, p.where("path = ''").select("source", F.col("present").alias("n")), "source")


@query(f"SELECT source, bucket, count(DISTINCT k) AS n_shapes FROM (SELECT source, rec_id % 8 AS k, CASE rec_id % 8 WHEN 0 THEN '4:2' WHEN 1 THEN '2:4' WHEN 2 THEN '2:3' WHEN 3 THEN '2:2' WHEN 7 THEN '4:2' END AS bucket FROM ({RECORDS})) WHERE bucket IS NOT NULL GROUP BY 1, 2")
def candidate_variants(spark, sf_dir):
    v = lifecycle.variants(classify.with_identity(records(spark, sf_dir)), "source")
    short = F.concat_ws(":", F.split_part("bucket", F.lit(":"), F.lit(3)), F.split_part("bucket", F.lit(":"), F.lit(4)))
    return v.groupBy("source", short.alias("bucket")).agg(F.count_distinct("fp").alias("n_shapes"))


# The stream's sides.


@query(f"""WITH r AS (SELECT rec_id % 8 AS k, source FROM ({RECORDS})), c AS (SELECT source, k, count(*) AS samples FROM r GROUP BY 1, 2)
 SELECT CASE WHEN r.k IN (0, 1) THEN 'matched_schema' WHEN r.k IN (2, 3, 7) AND samples >= 2 THEN 'matched_candidate' WHEN r.k IN (2, 3, 7) THEN 'new_candidate' WHEN r.k IN (4, 5) THEN 'malformed' ELSE 'tombstone' END AS told, CASE WHEN r.k IN (0, 1) THEN concat('fam-', r.k) END AS family_id, count(*) AS n
 FROM r JOIN c ON c.source = r.source AND c.k = r.k GROUP BY 1, 2""")
def stream_enrichment(spark, sf_dir):
    done = classify.classify(classify.with_identity(records(spark, sf_dir)), _known(spark))
    schemas = _known(spark).select("schema_id", F.replace("schema_id", F.lit("sch"), F.lit("fam")).alias("family_id"))
    seen = done.where("candidate is not null").groupBy("candidate").agg(F.count("*").alias("samples"))
    return registry.enriched(done, schemas, seen).groupBy("told", "family_id").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN event_id % 8 = 6 THEN 'tombstone' WHEN event_id % 8 IN (4, 5) THEN 'malformed' ELSE 'unresolved' END AS fate, count(*) AS n, count(*) FILTER (WHERE false) AS n_candidates FROM events GROUP BY 1")
def unresolved_records(spark, sf_dir):
    """Without a registry documents are unresolved, and none becomes a candidate."""
    done = classify.classify(classify.with_identity(records(spark, sf_dir)), None)
    return done.groupBy("fate").agg(F.count("*").alias("n"), F.count("candidate").alias("n_candidates"))


@query("SELECT DISTINCT p_name AS schema_id FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def families_in_buckets(spark, sf_dir):
    i = sql(spark, sf_dir, "SELECT p_brand AS bucket, p_type AS fp, p_name AS schema_id FROM part")
    return registry.in_buckets(i.select("schema_id").distinct(), i, ["Brand#1", "Brand#2", "Brand#3"])


@query("SELECT DISTINCT CASE WHEN o_orderkey % 3 = 1 THEN 'provisional' ELSE 'staged' END AS state, o_custkey AS candidate FROM orders WHERE o_orderkey % 3 <> 0")
def candidate_listing(spark, sf_dir):
    return lifecycle.listed(sql(spark, sf_dir, "SELECT o_custkey AS candidate, CASE o_orderkey % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'provisional' ELSE 'staged' END AS state FROM orders"))


@query("SELECT 'malformed' AS problem, CASE WHEN p_partkey % 4 = 0 THEN 'formline:index:x' ELSE concat('formline:index:4:2:', substr(sha256(p_name), 1, 8)) END AS bucket, CASE WHEN p_partkey % 5 = 0 THEN 'short' ELSE sha256(p_type) END AS fp FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 = 0")
def malformed_index_entries(spark, sf_dir):
    return registry.malformed(sql(spark, sf_dir, "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'formline:index:x' ELSE concat('formline:index:4:2:', substr(sha2(p_name, 256), 1, 8)) END AS bucket, CASE WHEN p_partkey % 5 = 0 THEN 'short' ELSE sha2(p_type, 256) END AS fp FROM part"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'shadow_only' WHEN o_orderkey % 3 = 0 THEN 'reject' WHEN o_custkey % 2 = 0 THEN 'apply' ELSE 'propose' END AS verdict FROM orders")
def trusted_verdicts(spark, sf_dir):
    o = sql(spark, sf_dir, "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN array('margin_too_small') ELSE CAST(array() AS array<string>) END AS reasons FROM orders")
    return o.select("o_orderkey", gates.trusted_verdict(F.col("o_orderkey") % 4 != 0, F.col("reasons"), F.col("o_custkey") % 2 == 0).alias("verdict"))


@query("SELECT event_type, round(CASE WHEN k = 0 THEN least(1, 3.0 / n) ELSE (p + 1.959963984540054 * 1.959963984540054 / (2 * n) + 1.959963984540054 * sqrt(p * (1 - p) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n))) / (1 + 1.959963984540054 * 1.959963984540054 / n) END, 9) AS bound FROM (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 1e6) AS k, k * 1.0 / n AS p FROM events GROUP BY 1) UNION ALL SELECT 'all', round((p + 1.959963984540054 * 1.959963984540054 / (2 * n) + 1.959963984540054 * sqrt(p * (1 - p) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n))) / (1 + 1.959963984540054 * 1.959963984540054 / n), 9) FROM (SELECT count(*) AS n, count(*) FILTER (WHERE value > 10) * 1.0 / count(*) AS p FROM events)")
def upper_bounds(spark, sf_dir):
    each = sql(spark, sf_dir, "SELECT event_type, count(*) AS n, count_if(value > 1e6) AS k FROM events GROUP BY 1").unionByName(sql(spark, sf_dir, "SELECT 'all' AS event_type, count(*) AS n, count_if(value > 10) AS k FROM events"))
    return each.select("event_type", F.round(evaluate.upper_bound_95(F.col("k"), F.col("n")), 9).alias("bound"))


@query(f"{with_paths()} SELECT source, path FROM s WHERE path <> ''")
def generalized_paths(spark, sf_dir):
    """The paths that annotations may name, read back from the generalized forms."""
    p = profile.profile(observe(records(spark, sf_dir), "source"), "source")
    made = profile.generalized(p, p.where("path = ''").select("source", F.col("present").alias("n")), "source")
    return made.select("source", F.explode(annotate.paths_of(F.col("canonical"), DEFAULT_TAGS.generalizer)).alias("path"))


@query("SELECT k, path FROM (VALUES (0, ['/amount', '/id', '/kind']), (1, ['/id', '/user', '/user/id', '/user/tags', '/user/tags/~*']), (2, ['/id', '/tags', '/tags/~*']), (3, ['/id', '/tags', '/tags/~*']), (7, ['/amount', '/id', '/kind'])) AS v(k, ps), unnest(ps) AS u(path) WHERE k IN (SELECT event_id % 8 FROM events)")
def shape_paths(spark, sf_dir):
    one = parse_records(records(spark, sf_dir)).where("canonical is not null").select((F.col("rec_id") % 8).cast("int").alias("k"), "canonical").distinct()
    return one.select("k", F.explode(annotate.paths_of(F.col("canonical"), DEFAULT_TAGS.canon)).alias("path"))


@query(f"""WITH r AS (SELECT event_id % 8 AS k, value FROM (SELECT rec_id AS event_id, value FROM ({RECORDS}))), f AS (SELECT CASE WHEN k IN (0, 1) THEN 'known' WHEN k IN (4, 5) THEN 'malformed' WHEN k = 6 THEN 'tombstone' ELSE 'provisional' END AS fate, k, value FROM r)
 SELECT 'records_total' AS series, '' AS label, count(*) AS value FROM f UNION ALL SELECT 'fate_total', fate, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'quarantine_total', CASE k WHEN 4 THEN 'duplicate_key' ELSE 'parse_error' END, count(*) FROM f WHERE k IN (4, 5) GROUP BY 2
 UNION ALL SELECT 'bytes_total', '', CAST(sum(coalesce(strlen(value), 0)) AS BIGINT) FROM f""")
def counters(spark, sf_dir):
    return evaluate.counters(classify.classify(classify.with_identity(records(spark, sf_dir)), _known(spark)))


@query("SELECT event_type, CAST(floor(v / s) * s AS BIGINT) AS low, count(*) AS n FROM (SELECT event_type, event_id * 7 AS v, CAST(power(10, greatest(length(CAST(event_id * 7 AS VARCHAR)) - 3, 0)) AS BIGINT) AS s FROM events) GROUP BY 1, 2")
def latency_histogram(spark, sf_dir):
    return evaluate.histogram(sql(spark, sf_dir, "SELECT event_type, event_id * 7 AS v FROM events"), "v", "event_type")


_VERSION_KEYS = "SELECT o_custkey AS family_id, o_orderkey AS schema_id, o_orderkey AS version, {0} AS keys FROM orders LEFT JOIN (SELECT l_orderkey, {1} AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"


@query(f"""WITH v AS ({_VERSION_KEYS.format("coalesce(k, [])", "list(DISTINCT l_linenumber)")}) SELECT x.schema_id, coalesce(bool_or(y.version < x.version AND len(y.keys) > 0 AND len(list_intersect(y.keys, x.keys)) = len(y.keys) AND len(x.keys) > len(y.keys)), false) AS added
 FROM v x JOIN v y ON x.family_id = y.family_id GROUP BY 1""")
def field_additions(spark, sf_dir):
    """Versions that only add fields to an earlier one of their family."""
    return evaluate.field_additions(sql(spark, sf_dir, _VERSION_KEYS.format("coalesce(k, CAST(array() AS array<int>))", "collect_set(l_linenumber)")))


# Evaluation in full.

_CASES = """SELECT o_orderkey AS id, o_orderstatus AS run, o_orderkey % 10 > 0 AS parsed, o_orderkey % 9 > 1 AS valid, o_orderkey % 3 = o_custkey % 3 AS correct, o_totalprice > 5000 AS accepted, CASE o_orderkey % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'new' ELSE 'abstain' END AS expected,
 CASE o_custkey % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'new' ELSE 'abstain' END AS predicted, o_custkey % 31 = 0 AS id_violation, o_orderkey % 4 <> 0 AS has_gold, CASE WHEN o_custkey % 7 < 6 THEN o_custkey % 7 + 1 END AS gold_rank, o_orderkey % 5 = 0 AS merge_trap, o_orderkey % 6 = 0 AS split_trap,
 o_custkey % 11 = 0 AS injected, o_orderkey % 4 AS repairs, CASE o_custkey % 40 WHEN 0 THEN 'timeout' WHEN 1 THEN 'provider' WHEN 2 THEN 'malformed' END AS error, o_orderkey % 2 = 0 AS cached, o_custkey AS tokens,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'known_exact' WHEN '2-HIGH' THEN 'compatible_drift' WHEN '3-MEDIUM' THEN 'incompatible_unsafe' WHEN '5-LOW' THEN 'new_family' ELSE 'ambiguous' END AS category FROM orders"""
_ALL = ", ".join(f"round(count(*) FILTER (WHERE ({f}) AND ({c})) * 1.0 / nullif(count(*) FILTER (WHERE {c}), 0), 9) AS {n}" for n, (f, c) in evaluate.METRICS.items())


@query(f"SELECT run, count(*) AS n, {_ALL}, round(sum(CASE WHEN has_gold AND gold_rank IS NOT NULL THEN 1.0 / gold_rank ELSE 0 END) / nullif(count(*) FILTER (WHERE has_gold), 0), 9) AS mrr, round(avg(repairs), 9) AS mean_repairs, round(avg(tokens), 9) AS mean_tokens FROM ({_CASES}) GROUP BY 1")
def decision_metrics(spark, sf_dir):
    out = evaluate.metrics(sql(spark, sf_dir, _CASES), "run")
    return out.select("run", "n", *[F.round(c, 9).alias(c) for c in out.columns if c not in ("run", "n")])


@query(f"SELECT category, n, round(accuracy, 9) AS accuracy FROM (SELECT category, count(*) AS n, count(*) FILTER (WHERE correct) * 1.0 / count(*) AS accuracy FROM ({_CASES}) GROUP BY 1 HAVING count(*) >= 20) ORDER BY accuracy, category LIMIT 1")
def worst_category(spark, sf_dir):
    return evaluate.worst_slice(sql(spark, sf_dir, _CASES), "category", 20).withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT o_orderpriority AS expected_relation, o_orderstatus AS predicted_relation, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 3 = 0 GROUP BY 1, 2")
def relation_confusion(spark, sf_dir):
    c = sql(spark, sf_dir, "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'match' ELSE 'new' END AS expected, CASE o_custkey % 3 WHEN 0 THEN 'match' ELSE 'new' END AS predicted, o_orderpriority AS expected_relation, o_orderstatus AS predicted_relation FROM orders")
    return evaluate.relation_confusion(c)


@query("SELECT count(*) AS n, round(count(*) FILTER (WHERE d = 1) * 1.0 / count(*), 9) AS repeated FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS d FROM orders GROUP BY 1)")
def repeatability(spark, sf_dir):
    return evaluate.repeatability(sql(spark, sf_dir, "SELECT o_orderkey AS run, o_custkey AS id, o_orderstatus AS decision FROM orders")).withColumn("repeated", F.round("repeated", 9))


_ITEMS = "SELECT event_type AS {0}, user_id AS item, count(*) AS n FROM events GROUP BY 1, 2"


@query(f"WITH x AS ({_ITEMS.format('a')}), z AS (SELECT a, sum(n) AS t FROM x GROUP BY 1) SELECT p.a AS a, q.a AS b, round(sum(least(p.n, q.n)) * 1.0 / (any_value(u.t) + any_value(w.t) - sum(least(p.n, q.n))), 9) AS similarity FROM x p JOIN x q ON p.item = q.item JOIN z u ON u.a = p.a JOIN z w ON w.a = q.a GROUP BY 1, 2")
def family_similarity(spark, sf_dir):
    return evaluate.multiset_jaccard(sql(spark, sf_dir, _ITEMS.format("a")), sql(spark, sf_dir, _ITEMS.format("b"))).withColumn("similarity", F.round("similarity", 9))


# Reshaping.


@query("SELECT s_nationkey AS nation, concat('b', CAST(s_suppkey % 3 AS VARCHAR)) AS k1, s_name AS k2, s_acctbal AS v FROM supplier")
def two_level_maps(spark, sf_dir):
    rows = sql(spark, sf_dir, "SELECT s_nationkey AS nation, b, map_from_entries(collect_list(struct(s_name, s_acctbal))) AS m FROM (SELECT *, concat('b', CAST(s_suppkey % 3 AS STRING)) AS b FROM supplier) GROUP BY 1, 2")
    return reshape.nested_entries(rows.groupBy("nation").agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("mm")), "mm", "k1", "k2", "v")


@query("SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, list(l_returnflag) AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE NOT list_contains(f, 'R')")
def existential_filters(spark, sf_dir):
    rows = sql(spark, sf_dir, "SELECT o_orderkey, f FROM orders LEFT JOIN (SELECT l_orderkey, collect_list(l_returnflag) AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
    return reshape.having(rows, "f", ("f", ["R"])).select("o_orderkey")


__all__ = ["ORACLE_SQL", "QUERIES"]
