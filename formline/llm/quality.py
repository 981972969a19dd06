"""Quality rules: a ledger of failure bits and measurements, policies over it, and ablations.

Every rule is evaluated once per document. The ledger is a written table with a 64-bit mask of failed
rules and the measurements behind them; a policy is a mask of the rules that count, so another policy, or
the ablation of one rule, reads the ledger and no text.

Null or empty texts have no words and fail ``few_words``. Rows are judged one by one, so repeated rows
agree and there are no ties to break. A very long text is measured whole, by one task, in time that
follows its length times its logarithm. An empty table gives an empty ledger. Other columns of the input
are not carried unless they are named, and their names then replace those of measurements.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Workspace, table, words_of

#: Words in a window, for repetition inside a text.
WINDOW = 8
#: Symbols that count as such.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails``, SQL over the measurements, is true."""

    name: str
    fails: str


#: The place of a rule is its bit; only append.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", "5 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)


def mask_of(*names: str) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(bits[n] for n in names)


#: Policies by version; published ones never change.
POLICIES = {
    "base": mask_of("few_words", "repeated_windows"),
    "v1": mask_of("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "short_words", "long_words"),
}


def _repeat_words() -> Column:
    """Words inside ``WINDOW``-word windows that the text, as column ``words``, holds twice or more.

    Windows are hashed, and only a text with a repeated hash sorts them by (hash, place). A window
    counts if a neighbour in that order has the same hash and the same words, so equality is that
    of words. Work and memory follow the length of the text, times its logarithm for the sort.
    """
    w = WINDOW
    grams = f"""transform(array(transform(words, x -> xxhash64(x))), wh ->
        if(size(wh) < {w}, cast(array() as array<bigint>),
           transform(sequence(0, size(wh) - {w}), i -> xxhash64(slice(wh, i + 1, {w})))))[0]"""
    same = f"slice(words, x.p + 1, {w}) = slice(words, get(s, i {{}} 1).p + 1, {w})"
    marked = f"""transform(array(sort_array(transform(h, (v, i) -> named_struct('h', v, 'p', i)))), s ->
        filter(s, (x, i) -> (get(s, i - 1).h <=> x.h and {same.format('-')})
                         or (get(s, i + 1).h <=> x.h and {same.format('+')})))[0]"""
    covered = f"""aggregate(sort_array(transform({marked}, x -> x.p)), named_struct('n', 0L, 'e', 0L),
        (a, p) -> named_struct('n', a.n + p + {w}L - greatest(cast(p as bigint), a.e), 'e', p + {w}L), a -> a.n)"""
    # Each part is bound once by a lambda, so that no later rewrite of the plan puts its making into a loop.
    counted = f"transform(array({grams}), h -> if(size(array_distinct(h)) = size(h), 0L, {covered}))[0]"
    return F.expr(f"transform(array(words), words -> {counted})[0]")


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document: the columns named in ``keep`` and its measurements."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = F.struct(*keep).alias("__row")
    with_words = docs.select(carried, text.alias("text"), words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    dup = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    spaces, symbols = (F.length(F.translate("text", x, "")) for x in (SPACES, SYMBOLS))
    return with_words.select(
        *[F.col("__row")[c].alias(c) for c in keep],
        F.size("words").cast("long").alias("n_words"),
        spaces.cast("long").alias("word_chars"),
        (F.length("text") - symbols).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        dup.cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
    )


def judged(docs: DataFrame, *keep: str) -> DataFrame:
    """Measurements and ``failed_bits``, a bit for each rule of ``RULES`` that the document fails, as a plan for one pass over the documents."""
    bits = "0L" + "".join(f" | if({r.fails}, {1 << i}L, 0L)" for i, r in enumerate(RULES))
    # A partition's number, times zero, keeps a policy's filter above the rules: below them, each would be evaluated again.
    return measure(docs, *(keep or ("doc_id",))).withColumn("failed_bits", F.expr(f"({bits}) | (spark_partition_id() * 0L)"))


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """The same as a written table, for many policies to read."""
    return Workspace(docs.sparkSession, "quality").save(judged(docs, *keep), "ledger")


def passes(policy: str) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, fail it alone, and pass without it.

    Entries are first counted by mask, of which there are at most 2 to the number of rules.
    """
    mask = POLICIES[policy]
    rules = [(i, r.name) for i, r in enumerate(RULES) if mask >> i & 1]
    names = F.explode(F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(n).alias("rule")) for i, n in rules]))
    counts = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    hit = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("m") == F.col("r.bit")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return (
        counts.withColumn("r", names)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(total(hit).alias("n_failed"), total(alone).alias("n_failed_alone"), total(alone | (F.col("m") == 0)).alias("n_kept_without"))
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged by the base rules and by policy v1."""
    out = ledger(table(spark, sf_dir, "documents"), "doc_id")
    base = F.col("failed_bits").bitwiseAND(F.lit(POLICIES["base"])) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes("v1").alias("kept"), "failed_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of policy v1, what it does alone."""
    return ablations(ledger(table(spark, sf_dir, "documents"), "doc_id"), "v1")


_BITS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT doc_id, i, words[i:i + 7] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN c ON t.doc_id = c.doc_id),
b AS (SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failed_bits FROM m)
"""

SQL = f"""{_BITS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""

_NAMES = ", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(RULES))

ABLATIONS_SQL = f"""{_BITS}
SELECT rule, count(*) FILTER (WHERE failed_bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed_bits = bit) AS n_failed_alone,
       count(*) FILTER (WHERE failed_bits & ~bit = 0) AS n_kept_without
FROM b, (VALUES {_NAMES}) AS r(rule, bit) GROUP BY rule
"""
