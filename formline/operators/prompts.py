"""What a model is shown of a candidate, and what it may answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Phrases and marks by which a field's name could pose as an instruction.
PHRASES = [
    "ignore previous", "ignore all previous", "ignore the above", "ignore above", "disregard previous", "disregard all previous", "disregard the above", "new instructions",
    "system prompt", "you are now", "act as", "pretend you are", "override your instructions", "output match_schema", "system:", "assistant:", "developer:", "###",
]
MARKS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "[inst]", "[/inst]", "<<sys>>", "<</sys>>"]
NAME_CHARS, MAX_FIELDS, MAX_DEPTH = 64, 64, 12


def flagged(name: Column) -> Column:
    """Whether a name looks like an instruction, a turn mark, hides its reading direction, or mixes letters of scripts that look alike."""
    low = F.lower(name)
    latin, cyrillic, greek = (name.rlike(rf"\p{{Is{x}}}") for x in ("Latin", "Cyrillic", "Greek"))
    out = name.rlike(r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{0}-\x{1F}\x{7F}-\x{9F}]")
    out = out | (latin & cyrillic) | (latin & greek) | (cyrillic & greek)
    for text in [*PHRASES, *MARKS]:
        out = out | low.contains(text)
    return out


def shown(name: Column) -> Column:
    """A name cut to 64 characters and escaped as JSON."""
    return F.to_json(F.struct(F.substring(name, 1, NAME_CHARS).alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.substring(name, 1, NAME_CHARS).alias("n")))) - 6)


def view(profiles: DataFrame, by: str) -> DataFrame:
    """(by, path, place, truncated): a candidate's first 64 paths of at most 12 steps, and whether there are more."""
    steps = F.size(F.split("path", "/")) - 1
    ranked = profiles.withColumn("__fits", steps <= MAX_DEPTH).withColumn("place", F.row_number().over(W.partitionBy(by, "__fits").orderBy("path")))
    cut = ranked.withColumn("truncated", F.max(~F.col("__fits") | (F.col("place") > MAX_FIELDS)).over(W.partitionBy(by)))
    return cut.where(F.col("__fits") & (F.col("place") <= MAX_FIELDS)).select(by, "path", "place", "truncated")


def prompt(views: DataFrame, by: str) -> DataFrame:
    """(by, prompt, digest): the fields of a view in order, as a text with its hash."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: F.concat(F.lit("- "), x["path"]))
    made = views.groupBy(by).agg(F.concat(F.lit("FIELDS\n"), F.array_join(lines, "\n")).alias("prompt"))
    return made.withColumn("digest", F.sha2("prompt", 256))


def decision(answer: Column, allowed: Column) -> Column:
    """A model's JSON answer as one of match, new, abstain or invalid; an id that was not offered is an abstention."""
    got = F.from_json(answer, "decision string, schema_id string")
    extra = F.size(F.array_except(F.json_object_keys(answer), F.array(*map(F.lit, ["decision", "schema_id", "relation", "novelty", "cause"])))) > 0
    kind = got["decision"]
    return (
        F.when(kind.isNull() | F.coalesce(extra, F.lit(True)), "invalid").when((kind == "match_schema") & F.array_contains(allowed, got["schema_id"]), "match")
        .when(kind == "match_schema", "abstain").when(kind == "new_candidate", "new").when(kind == "abstain", "abstain").otherwise("invalid")
    )
