"""Quality rules and line dedup, against plain Python and DuckDB."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from formline.llm import linededup, quality
from tests.oracle import check

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def made(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


def odd_texts():
    rng = random.Random(4)
    words = ["a", "bé", "cc", "d#", "|", "e"]
    texts = [None, "", " ", "\n\n", "\t\x0b x \x0c", "one two", "a\xa0b c", "x" * 50_000, "a b " * 20_000, "🎉 " * 25]
    for n in (7, 8, 9, 16, 17, 40, 300):
        texts += [" ".join(rng.choice(words) for _ in range(n)) + "\n" + " ".join(rng.choice(words[:3]) for _ in range(n)) for _ in range(6)]
    texts += ["l1 w\nl1 w\n l1 w\nl1 w \n\nl1 w"] * 2
    return texts


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeat = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeat.update(i + k for i in places for k in range(8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


def test_measurements(spark):
    texts = odd_texts()
    # Columns of the input that are named like measurements must not get in the way.
    docs = made(spark, texts, n_words=-1, words="w", failed_bits="x")
    got = {r["doc_id"]: r for r in quality.ledger(docs, "doc_id").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measured(t), (i, t and t[:60])


def test_policies_and_ablations(spark):
    entries = quality.ledger(made(spark, odd_texts()), "doc_id")
    rows = [r["failed_bits"] for r in entries.collect()]
    mask = quality.POLICIES["v1"]
    assert entries.where(quality.passes("v1")).count() == sum(b & mask == 0 for b in rows)
    for r in quality.ablations(entries, "v1").collect():
        bit = quality.mask_of(r["rule"])
        assert r["n_failed"] == sum(b & bit != 0 for b in rows)
        assert r["n_failed_alone"] == sum(b & mask == bit for b in rows)
        assert r["n_kept_without"] == sum(b & mask & ~bit == 0 for b in rows)


def test_quality_of_nothing(spark):
    assert quality.ledger(made(spark, ["x"]).limit(0), "doc_id").count() == 0


@pytest.mark.parametrize("name,module", [("op3_quality", quality), ("op9_linededup", linededup)])
def test_against_sql(spark, small, name, module):
    check(getattr(module, name)(spark, small), small, module.SQL)


def test_ablations_against_sql(spark, small):
    check(quality.quality_ablations(spark, small), small, quality.ABLATIONS_SQL)


def deduped(texts):
    """Plain Python: {doc: (kept text, lines, dropped)}."""
    key = lambda x: x.strip(SPACES).translate(ASCII_LOWER)
    owner = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            owner.setdefault(key(x), i)
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        out[i] = "\n".join(kept), len(lines), len(lines) - len(kept)
    return out


def line_texts():
    rng = random.Random(9)
    pool = [f"  Shared LINE number {i} \t" for i in range(12)] + ["short", "", "ÄÖÜ gemeinsame Zeile", "äöü gemeinsame zeile"]
    texts = [None, "", "\n", "\n\n\n", "\x1cShared LINE number 1", "Shared line NUMBER 1\nShared line number 1"]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    return texts + texts[6:30] + ["Shared LINE number 3\n" * 3000]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 3), (5, 2)])
def test_line_dedup(spark, batches, fanout):
    texts = line_texts()
    docs = made(spark, texts, place=1, h1="x", batch=7).repartition(3)
    got = {r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(docs, batches=batches, fanout=fanout).collect()}
    assert got == deduped(texts)
    assert spark.sql("SHOW TABLES").where("tableName LIKE 'formline_run%'").count() == 0


def test_line_dedup_edges(spark):
    docs = made(spark, ["a line that repeats", "a line that repeats"])
    same = docs.unionByName(docs.where("doc_id = 0"))  # a repeated row is the same document
    assert sorted((r["doc_id"], r["n_dropped"]) for r in linededup.dedup_lines(same).collect()) == [(0, 0), (0, 0), (1, 1)]
    nameless = docs.withColumn("doc_id", F.expr("nullif(doc_id, 0)"))
    assert sorted(r["n_dropped"] for r in linededup.dedup_lines(nameless).collect()) == [0, 0]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_runs_take_batches_as_they_come(spark):
    from formline.llm.common import Workspace

    runs = linededup.LineRuns(Workspace(spark, "test"), 2, fanout=2)
    dropped = []
    for i in range(5):
        lines = linededup.hashed(made(spark, [f"only in batch {i}!!", "in every batch"]).withColumn("doc_id", F.col("doc_id") + 2 * i))
        dropped.append(runs.absorb(lines).count())
        assert sum(map(len, runs.levels)) <= 3
    assert dropped == [0, 1, 1, 1, 1]
    runs.forget()


def test_no_run_is_sorted_or_shuffled_again(spark):
    """Runs are scanned in their stored order, compacted runs leave no files, and forgotten ones neither."""
    from pathlib import Path

    from formline.llm.common import Workspace

    space = Workspace(spark, "test")
    runs = linededup.LineRuns(space, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout=3)
    batch = lambda i: linededup.hashed(made(spark, [f"only in batch {i}, line {k}" for k in range(50)]).withColumn("doc_id", F.col("doc_id") + 50 * i))
    for i in range(2):
        runs.absorb(batch(i)).count()
    with linededup.setting(spark, linededup.ORDERED, "true"):
        plan = runs.merged(batch(2))._jdf.queryExecution().executedPlan().toString().split("\n")
    plan = [x for x in plan if x.startswith(" ")]  # not the rest of a line that an expression breaks
    scans = [i for i, x in enumerate(plan) if "formline_run_" in x and "Scan parquet" in x and "Batched" in x]
    assert len(scans) == 2
    for i in scans:
        depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
        above, level = [], depth(plan[i])
        for x in reversed(plan[:i]):
            if depth(x) < level:
                above.append(x.lstrip(" :+-|"))
                level = depth(x)
        upto = above[: next(k for k, x in enumerate(above) if "SortMergeJoin" in x)]
        assert not any(x.startswith(("Sort ", "Exchange")) for x in upto), upto
    files = lambda: [p for p in Path(space.root.removeprefix("file:")).glob("*-run") if p.is_dir()]
    assert len(files()) == 2
    runs.absorb(batch(2)).count()
    assert len(runs.runs()) == len(files()) == 1
    runs.forget()
    assert not files()


def test_clashing_names_are_replaced(spark):
    docs = made(spark, ["a line that repeats", "a line that repeats"], kept_text="k", n_lines="n", __id=5, h1="x")
    out = linededup.dedup_lines(docs)
    assert len(set(out.columns)) == len(out.columns)
    assert sorted((r["doc_id"], r["kept_text"], r["n_lines"], r["__id"], r["h1"]) for r in out.collect()) == [(0, "a line that repeats", 1, 5, "x"), (1, "", 1, 5, "x")]


def test_digest(spark, small):
    row = linededup.op9_linededup(spark, small).orderBy("doc_id").first()
    text = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
