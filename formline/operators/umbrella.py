"""Consolidation: units, verified field mappings, groups of like schemas, and compiled transforms."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strictjson import Number, Rejected, parse

# What units measure.
DIMENSIONS = {
    "Cel": "temperature", "K": "temperature", "[degF]": "temperature", "Pa": "pressure", "hPa": "pressure", "kPa": "pressure", "bar": "pressure",
    "W": "power", "kW": "power", "MW": "power", "GW": "power", "J": "energy", "kW.h": "energy", "MW.h": "energy", "s": "time", "min": "time", "h": "time",
    "m": "length", "km": "length", "1": "dimensionless", "%": "dimensionless",
}

# Conversions as value * factor + offset.
CONVERSIONS = {
    ("Cel", "K"): (1.0, 273.15), ("K", "Cel"): (1.0, -273.15), ("hPa", "Pa"): (100.0, 0.0), ("Pa", "hPa"): (0.01, 0.0), ("kPa", "Pa"): (1000.0, 0.0),
    ("kW", "W"): (1000.0, 0.0), ("MW", "W"): (1_000_000.0, 0.0), ("GW", "W"): (1_000_000_000.0, 0.0), ("W", "kW"): (0.001, 0.0), ("W", "MW"): (0.000001, 0.0),
    ("km", "m"): (1000.0, 0.0), ("m", "km"): (0.001, 0.0), ("h", "s"): (3600.0, 0.0), ("min", "s"): (60.0, 0.0),
}


def convert(value: Column, unit: Column, to: str) -> Column:
    """The value in the unit ``to``; null if no rule leads there."""
    out = F.when(unit == to, value)
    for (a, b), (factor, offset) in CONVERSIONS.items():
        if b == to:
            out = out.when(unit == a, value * factor + offset)
    return out


def unit_relation(a: Column, b: Column) -> Column:
    """same, convertible, incomparable; null units on both sides are the same."""
    known = F.array(*[F.lit(f"{x}>{y}") for x, y in CONVERSIONS])
    return F.when(a.eqNullSafe(b), "same").when(F.array_contains(known, F.concat_ws(">", a, b)), "convertible").otherwise("incomparable")


def lossless(child: Column, target: Column) -> Column:
    """Equal types, or an integer as a decimal, and nothing else."""
    return (child == target) | ((child == "integer") & (target == "decimal"))


def pair_fields(child: DataFrame, umbrella: DataFrame) -> DataFrame:
    """Verdicts on fields (schema_id, path, cfid, type, unit) and an umbrella's (cfid, target, target_type, target_unit).

    A conversion gives a decimal whatever the field's type; whether it may is a matter of verification.
    """
    joined = child.join(umbrella, "cfid")
    units = unit_relation(F.col("unit"), F.col("target_unit"))
    fits = lossless(F.col("type"), F.col("target_type"))
    verdict = F.when((units == "same") & fits, "exact_equivalent").when(units == "convertible", "same_quantity_different_unit").otherwise("unknown")
    return joined.withColumn("verdict", verdict)


def assemble(paired: DataFrame) -> DataFrame:
    """(schema_id, path, target, cast, rule, on_missing) of paired fields that bind by themselves; paths are unique in a schema.

    ``paired`` is as from ``pair_fields``, with ``required`` of the target. The first field in path order takes a target, and a
    field the first of its targets; fields that bind nothing are not here. A cast comes before a conversion.
    """
    bindable = paired.where(F.col("verdict").isin("exact_equivalent", "same_quantity_different_unit"))
    each = bindable.groupBy("schema_id", "path").agg(F.min(F.struct("target", "target_type", "target_unit", "type", "unit", "required")).alias("b"))
    one = each.groupBy("schema_id", F.col("b.target").alias("target")).agg(F.min(F.struct("path", "b")).alias("m"))
    b = "m.b."
    cast = F.when((F.col(b + "type") != F.col(b + "target_type")) & lossless(F.col(b + "type"), F.col(b + "target_type")), F.col(b + "target_type"))
    rule = F.when(~F.col(b + "unit").eqNullSafe(F.col(b + "target_unit")), F.concat_ws(">", F.col(b + "unit"), F.col(b + "target_unit")))
    return one.select("schema_id", F.col("m.path").alias("path"), "target", cast.alias("cast"), rule.alias("rule"), F.when(F.col(b + "required"), "reject").otherwise("omit").alias("on_missing"))


def sound(bindings: DataFrame, child: DataFrame, umbrella: DataFrame) -> DataFrame:
    """(schema_id, problems) of assembled transforms, one row for each schema of ``child``: what static verification finds.

    ``umbrella`` has (target, target_type, target_unit, required). A schema's fields and bindings meet in its own rows, so a child that
    is dealt by schemas is not shuffled again, and required targets are one list that each schema's own are taken from.
    """
    own, bound = "struct<type:string,unit:string>", "struct<target:string,cast:string,rule:string,on_missing:string>"
    held = child.groupBy("schema_id").agg(F.collect_list(F.struct("path", F.struct("type", "unit").cast(own).alias("f"), F.lit(None).cast(bound).alias("b"))).alias("held"))
    bind = bindings.groupBy("schema_id").agg(F.collect_list(F.struct("path", F.lit(None).cast(own).alias("f"), F.struct("target", "cast", "rule", "on_missing").cast(bound).alias("b"))).alias("bind"))
    each = held.join(bind, "schema_id", "left").select("schema_id", F.explode(F.when(F.col("bind").isNull(), F.col("held")).otherwise(F.concat("held", "bind"))).alias("e"))
    by = each.groupBy("schema_id", F.col("e.path").alias("path")).agg(F.collect_list("e.f").alias("fs"), F.collect_list("e.b").alias("bs"))
    b = by.select("schema_id", "path", F.when(F.col("path").isNotNull() & (F.size("bs") > 0), F.col("fs")).alias("fs"), F.explode_outer("bs").alias("b")).select("schema_id", "path", "b", F.explode_outer("fs").alias("f"))
    b = b.select("schema_id", "path", F.col("b").isNotNull().alias("__bound"), "b.*", F.col("f.type").alias("__type"), F.col("f.unit").alias("__unit")).join(umbrella, "target", "left")
    ends = F.when(F.col("rule").isNotNull(), F.lit("decimal")).otherwise(F.coalesce("cast", "__type"))
    unit = F.when(F.col("rule").isNotNull(), F.split_part("rule", F.lit(">"), F.lit(2))).otherwise(F.col("__unit"))
    b = b.withColumn("__twice", F.count("*").over(W.partitionBy("schema_id", "target")) > 1)
    found = F.array_compact(F.array(
        F.when(F.col("__type").isNull(), F.concat_ws(":", F.lit("source_missing"), "path")),
        F.when(F.col("target_type").isNull(), F.concat_ws(":", F.lit("unknown_target"), "target")),
        F.when(F.col("__twice"), F.concat_ws(":", F.lit("duplicate_target"), "target")),
        F.when(F.col("required") & (F.col("on_missing") == "omit"), F.concat_ws(":", F.lit("omit_on_required"), "target")),
        F.when(F.col("cast").isNotNull() & ~lossless(F.col("__type"), F.col("cast")), F.concat_ws(":", F.lit("lossy_cast"), "target")),
        F.when(~lossless(ends, F.col("target_type")), F.concat_ws(":", F.lit("type_mismatch"), "target")),
        F.when(F.col("rule").isNotNull() & ~F.col("rule").isin(*[f"{x}>{y}" for x, y in CONVERSIONS]), F.concat_ws(":", F.lit("bad_unit_op"), "target")),
        F.when(F.col("target_unit").isNotNull() & ~unit.eqNullSafe(F.col("target_unit")), F.concat_ws(":", F.lit("bad_unit"), "target")),
    ))
    lacks = lambda c: F.concat_ws(":", F.lit("required_not_total"), c)
    total = F.when((F.col("on_missing") != "omit") & F.col("target").isNotNull(), lacks("target"))
    told = b.groupBy("schema_id").agg(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("__bound"), found)))).alias("found"), F.collect_set(total).alias("total"))
    needs = umbrella.where("required").agg(F.sort_array(F.collect_set(lacks("target"))).alias("needs"))
    problems = F.sort_array(F.concat("found", F.array_except("needs", "total")))
    return told.crossJoin(F.broadcast(needs)).select("schema_id", F.when(F.col("schema_id").isNull(), F.array().cast("array<string>")).otherwise(problems).alias("problems"))


def proposals(fields: DataFrame, members: DataFrame, verified: DataFrame, decided: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(signature, n, n_verified, n_clusters, state) of groups of annotated schemas.

    ``members`` has (schema_id, cluster), the cluster of the schema's source or null; ``verified`` has (schema_id, problems). A
    group is proposed if ``least`` members' transforms are sound, suppressed if its known clusters differ, and a group that was
    decided keeps its state.
    """
    sets = fields.groupBy("schema_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", "cfid", "type"))), "|").alias("signature"))
    rows = sets.join(verified.select("schema_id", (F.size("problems") == 0).alias("__sound")), "schema_id", "left").join(members, "schema_id", "left")
    # A set of clusters and not a distinct count, which would shuffle every signature twice.
    by = rows.groupBy("signature").agg(F.count("*").alias("n"), F.count_if("__sound").alias("n_verified"), F.size(F.collect_set("cluster")).cast("long").alias("n_clusters")).where(F.col("n") >= least)
    state = F.when(F.col("n_clusters") > 1, "suppressed").when(F.col("n_verified") < least, "unverified").otherwise("proposed")
    if decided is None:
        return by.withColumn("state", state)
    return by.join(decided.withColumnRenamed("state", "__was"), "signature", "left").withColumn("state", F.coalesce("__was", state)).drop("__was")


def decide(proposed: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcomes of requests (signature, wanted, reason) on proposals (signature, state, n_verified): a reason is required, only a proposal can be decided, and what is approved must still be verified."""
    joined = requests.join(proposed, "signature", "left")
    outcome = (
        F.when(F.col("state").isNull(), "not_found").when(F.coalesce(F.btrim("reason"), F.lit("")) == "", "reason_required")
        .when(F.col("state") == F.col("wanted"), "already_decided").when(F.col("state") != "proposed", "conflict")
        .when((F.col("wanted") == "approved") & (F.col("n_verified") < 2), "not_verified").otherwise(F.col("wanted"))
    )
    return joined.select("signature", "wanted", outcome.alias("outcome"))


def groups(fields: DataFrame, least: int = 2) -> DataFrame:
    """(signature, members, n): schemas with the same set of (cfid, type), at least ``least`` of them."""
    sets = fields.groupBy("schema_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", "cfid", "type"))), "|").alias("signature"))
    return sets.groupBy("signature").agg(F.sort_array(F.collect_set("schema_id")).alias("members"), F.count("*").alias("n")).where(F.col("n") >= least)


MIN_SUPPORT = 30


def value_guard(profiles: DataFrame) -> DataFrame:
    """(cfid, a, b, verdict) of members' value evidence (cfid, schema_id, mask, support, unit), each pair once.

    Contradictory if the bucket masks share nothing, both are well supported, and the units agree.
    """
    other = profiles.select("cfid", F.col("schema_id").alias("b"), F.col("mask").alias("__m"), F.col("support").alias("__s"), F.col("unit").alias("__u"))
    pairs = profiles.withColumnRenamed("schema_id", "a").join(other, "cfid").where("a < b")
    enough = (F.col("support") >= MIN_SUPPORT) & (F.col("__s") >= MIN_SUPPORT)
    verdict = (
        F.when(~F.col("unit").eqNullSafe(F.col("__u")), "not_comparable").when(~enough, "unknown")
        .when(F.col("mask").bitwiseAND(F.col("__m")) == 0, "contradictory").otherwise("compatible")
    )
    return pairs.select("cfid", "a", "b", verdict.alias("verdict"))


@dataclass(frozen=True)
class Binding:
    """Where a target field comes from, and what becomes of it."""

    target: str
    path: str | None = None
    type: str = "string"
    unit: tuple[str, str] | None = None
    default: object = None
    required: bool = False


_SPARK = {"bool": "boolean", "integer": "bigint", "decimal": "double", "string": "string"}


def verify(bindings: list[Binding]) -> list[str]:
    """What is wrong with a transform, before it runs."""
    out, seen = [], set()
    for b in bindings:
        if b.target in seen:
            out.append(f"duplicate_target:{b.target}")
        seen.add(b.target)
        if b.type not in _SPARK:
            out.append(f"unknown_type:{b.target}")
        if b.path is None and b.default is None:
            out.append(f"unbound:{b.target}")
        if b.unit and b.unit not in CONVERSIONS:
            out.append(f"no_conversion:{b.target}")
        if b.unit and b.type != "decimal":
            out.append(f"unit_needs_decimal:{b.target}")
    return out


_CLASS = {"boolean": "bool", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "decimal", "double": "decimal", "string": "string"}


def transform(rows: DataFrame, bindings: list[Binding]) -> DataFrame:
    """Rows with a column per binding, and ``rejected``: the first required field that is missing or field that does not widen.

    A cast never changes a value: a column whose type does not widen to the target's rejects every row that has a value in it. A
    null is a missing field here, as columns cannot tell it from one that is not there; ``applied`` reads documents and can.
    """
    if problems := verify(bindings):
        raise ValueError("; ".join(problems))
    made, rejected = [], F.lit(None).cast("string")
    for b in bindings:
        value = F.lit(None).cast(_SPARK[b.type]) if b.path is None else F.col(b.path)
        if b.path is not None:
            kind = rows.select(value).schema[0].dataType.simpleString()
            kind = "decimal" if kind.startswith("decimal(") else _CLASS.get(kind)
            if kind != b.type and (kind, b.type) != ("integer", "decimal"):
                rejected = F.coalesce(rejected, F.when(value.isNotNull(), F.lit(b.target)))
                value = F.lit(None)
            value = value.cast(_SPARK[b.type])
        if b.unit:
            factor, offset = CONVERSIONS[b.unit]
            value = value * factor + offset
        if b.default is not None:
            value = F.coalesce(value, F.lit(b.default).cast(_SPARK[b.type]))
        made.append(value.alias(b.target))
        if b.required:
            rejected = F.coalesce(rejected, F.when(value.isNull(), F.lit(b.target)))
    return rows.select("*", *made, rejected.alias("rejected"))


@dataclass(frozen=True)
class Step:
    """One operation on a value: ``cast`` to a type, ``convert`` by units, ``default``, or ``each`` for the elements of an array."""

    op: str
    to: str | None = None
    units: tuple[str, str] | None = None
    value: object = None
    steps: tuple = ()


@dataclass(frozen=True)
class Move:
    """A value from one dotted path of a document to another."""

    source: str
    target: str
    steps: tuple[Step, ...] = ()
    on_missing: str = "omit"  # or reject, or default


class Refused(Exception):
    """A document that a transform does not take."""


def _scalar(value: object) -> str | None:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, Number):
        return "decimal" if any(c in value for c in ".eE") else "integer"
    return "string" if isinstance(value, str) else None


def _stepped(value: object, steps: tuple[Step, ...], path: str) -> object:
    for s in steps:
        if s.op == "cast":
            kind = _scalar(value)
            if kind is None or kind != s.to and (kind, s.to) != ("integer", "decimal"):
                raise Refused(f"cast:{path}")
        elif s.op == "convert":
            if not isinstance(value, Number):
                raise Refused(f"no_number:{path}")
            x = float(value)
            if x in (float("inf"), float("-inf")):
                raise Refused(f"not_finite:{path}")
            factor, offset = CONVERSIONS[s.units]
            value = Number(repr(x * factor + offset))
        elif s.op == "each":
            if not isinstance(value, list):
                raise Refused(f"no_array:{path}")
            value = [_stepped(v, s.steps, path) for v in value]
    return value


def apply(document: dict, moves: list[Move]) -> dict:
    """The moved document. A null that is there is a value: it passes without steps and no cast takes it."""
    out: dict = {}
    for m in moves:
        try:
            value = get_path(document, m.source)
        except KeyError:
            if m.on_missing == "reject":
                raise Refused(f"missing:{m.source}") from None
            given = [s for s in m.steps if s.op == "default"]
            if m.on_missing == "default":
                if not given:
                    raise Refused(f"no_default:{m.source}") from None
                set_path(out, m.target, given[0].value)
            continue
        set_path(out, m.target, _stepped(value, m.steps, m.source))
    return out


def applied(column: Column, moves: list[Move]) -> Column:
    """JSON documents as struct of the moved document and why it was refused."""
    from .dlp import written

    @F.pandas_udf("struct<document string, refused string>")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append((None, "no_document") if v is None else (written(apply(parse(v.encode() if isinstance(v, str) else bytes(v)), moves)), None))
            except Rejected as e:
                rows.append((None, e.reason))
            except (Refused, ValueError) as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["document", "refused"])

    return run(column)


def ddl(bindings: list[Binding]) -> str:
    return ", ".join(f"`{b.target}` {_SPARK[b.type].upper()}{' NOT NULL' if b.required else ''}" for b in bindings)


def contract(rows: DataFrame, types: dict[str, str], key: str) -> DataFrame:
    """(n, n_valid, n_keys): rows whose fields are all there and cast to their types, and distinct keys among those."""
    valid = F.lit(True)
    for name, kind in types.items():
        valid = valid & F.col(name).try_cast(_SPARK[kind]).isNotNull()
    return rows.agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.count_distinct(F.when(valid, F.col(key))).alias("n_keys"))


def umbrella_digest(signature: Column) -> Column:
    """64-bit FNV-1a of a signature's bytes as 16 hex digits, in decimals of SQL so that products do not overflow."""
    modulus, prime = "18446744073709551616", "1099511628211"
    start = F.struct(F.lit("14695981039346656037").cast("decimal(20,0)").alias("h"))

    def step(acc, pair):
        byte = F.conv(pair, 16, 10).cast("long")
        low = F.pmod(acc["h"], F.lit(256)).cast("long")
        mixed = (acc["h"] - low.cast("decimal(20,0)") + low.bitwiseXOR(byte).cast("decimal(20,0)")).cast("decimal(20,0)")
        # mixed * prime modulo 2^64, by the halves of mixed: the upper one's product only counts in its lower 32 bits.
        upper, lower = F.floor(mixed / F.lit("4294967296").cast("decimal(10,0)")).cast("decimal(20,0)"), F.pmod(mixed, F.lit("4294967296").cast("decimal(20,0)"))
        high = F.pmod((upper * F.lit(prime).cast("decimal(13,0)")).cast("decimal(38,0)"), F.lit("4294967296").cast("decimal(38,0)"))
        total = (high * F.lit("4294967296").cast("decimal(10,0)")).cast("decimal(38,0)") + (lower * F.lit(prime).cast("decimal(13,0)")).cast("decimal(38,0)")
        return F.struct(F.pmod(total.cast("decimal(38,0)"), F.lit(modulus).cast("decimal(38,0)")).cast("decimal(20,0)").alias("h"))

    pairs = F.filter(F.regexp_extract_all(F.hex(signature.cast("binary")), F.lit("(..)"), F.lit(1)), lambda x: x != "")
    digits = F.aggregate(pairs, start, step, lambda a: a["h"]).cast("string")
    return F.lower(F.lpad(F.conv(digits, 10, 16), 16, "0"))


def get_path(document: dict, path: str):
    """What stands at a dotted path of object keys; KeyError if nothing does."""
    for key in path.split("."):
        if not isinstance(document, dict):
            raise KeyError(path)
        document = document[key]
    return document


def set_path(document: dict, path: str, value) -> None:
    """Puts a value at a dotted path, making objects on the way; a scalar in the way is an error."""
    *way, last = path.split(".")
    for key in way:
        document = document.setdefault(key, {})
        if not isinstance(document, dict):
            raise ValueError(f"{path} goes through a scalar")
    document[last] = value


def replay(rows: DataFrame, bindings: list[Binding]) -> DataFrame:
    """(n, n_rejected, deterministic) of applying a transform twice to samples."""
    columns = [b.target for b in bindings]
    once, twice = (transform(rows, bindings).select(*columns, "rejected") for _ in range(2))
    hash_of = lambda df: df.agg(F.count("*").alias("n"), F.count("rejected").alias("n_rejected"), F.coalesce(F.bit_xor(F.xxhash64(*columns, "rejected")), F.lit(0)).alias("h"))
    return hash_of(once).join(F.broadcast(hash_of(twice).select(F.col("h").alias("h2"))), F.lit(True)).select("n", "n_rejected", (F.col("h") == F.col("h2")).alias("deterministic"))


def corroborated(members: DataFrame, generic: list[str]) -> DataFrame:
    """(cfid, corroborated): two members at least, and all call the field alike, and by a name that says something; from (cfid, name)."""
    bare = F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[^a-z0-9]", "")
    telling = (F.min(bare) != "") & ~F.min(bare).isin(*generic)
    return members.groupBy("cfid").agg(((F.count("*") >= 2) & (F.min(bare) == F.max(bare)) & telling).alias("corroborated"))
