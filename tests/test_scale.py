"""What queries shuffle: pairs are made after the shuffle of their sides, and what all rows share is not joined to each."""

import contextlib
import io
import re
from collections import Counter

from pyspark.sql import functions as F

from formline.operators import semantic, umbrella


def exchanged(df):
    """The keys that rows are dealt by in a plan."""
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return [sorted(re.sub(r"#\d+L?", "", k).split(", ")[:-1]) for k in re.findall(r"Exchange hashpartitioning\((.*?)\)", out.getvalue())]


def test_similarities_are_summed_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(semantic, "STEP", 3, raising=False)
    rows = [(s, f"f{f}", "event" if (s + f) % 3 else "field", (s * f) % 4 + 1) for s in range(40) for f in range(1, 9) if s % f == 0 or s == f] + [(4, "f3", "unit", 2), (None, "f3", "unit", 1), (5, None, "unit", 1)]
    s = spark.createDataFrame(rows, "schema_id long, feature string, kind string, count long")
    assert ["a", "b"] not in exchanged(semantic.similarities(s, semantic.idf(s)))
    got = semantic.similarities(s)
    df, n = Counter(f for _, f, _, _ in rows), len({s for s, *_ in rows if s is not None})
    idf = {f: 0 if n // c < 2 else min((n // c).bit_length() - 1, 16) for f, c in df.items()}
    w = [(s, f, semantic.CLASS_WEIGHTS[k] * idf[f], c) for s, f, k, c in rows if f and idf[f] and s is not None]
    num, mass = Counter(), Counter()
    for s1, f1, w1, c1 in w:
        mass[s1] += w1 * c1
        for s2, f2, _, c2 in w:
            if f1 == f2 and s1 != s2:
                num[s1, s2] += w1 * min(c1, c2)
    want = {(a, b, x, mass[a] + mass[b] - x) for (a, b), x in num.items()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 100
    assert {tuple(r) for r in semantic.similarities(s, semantic.idf(s)).collect()} == want
    monkeypatch.setattr(semantic, "MAX_BROADCAST", 0)
    assert {tuple(r) for r in semantic.similarities(s).collect()} == want


def test_required_targets_are_not_joined_to_every_schema(spark):
    child = spark.createDataFrame([("s", "/a", "string", None), ("s", "/b", "integer", "kW"), ("t", "/a", "decimal", None), (None, "/a", "decimal", None), ("u", None, "decimal", None)], "schema_id string, path string, type string, unit string")
    targets = spark.createDataFrame([("x", "decimal", None, True), ("y", "decimal", "W", False), (None, "decimal", None, True), ("z", "string", None, True)], "target string, target_type string, target_unit string, required boolean")
    schema = "schema_id string, path string, target string, cast string, rule string, on_missing string"
    bound = [("s", "/a", "x", None, None, "reject"), ("s", "/b", "x", None, None, "omit"), ("s", "/b", "z", None, None, None), ("t", "/a", "z", None, None, "reject"), ("t", "/c", None, None, None, "reject"), (None, "/a", "x", None, None, "reject"), ("u", None, "x", None, None, "reject"), ("gone", "/a", "x", None, None, "omit")]
    got = umbrella.sound(spark.createDataFrame(bound, schema), child, targets)
    want = {
        "s": ["duplicate_target:x", "omit_on_required:x", "required_not_total", "required_not_total:z", "type_mismatch:x", "type_mismatch:z"],
        "t": ["required_not_total", "required_not_total:x", "source_missing:/c", "type_mismatch:z", "unknown_target"],
        "u": ["required_not_total", "required_not_total:z", "source_missing"], None: [],
    }
    assert {r["schema_id"]: r["problems"] for r in got.collect()} == want
    assert ["schema_id", "target"] not in exchanged(got)


def test_meanings_that_collide_bring_what_is_compared(spark):
    rows = spark.createDataFrame([("m", 1, 0.9, "e"), ("m", 2, 0.8, None), ("m", 3, 0.0, None), ("n", 4, 1.0, "e"), (None, 5, 1.0, "e"), (None, 6, 1.0, "e")], "sem_id string, schema_id long, coverage double, event string")
    got = semantic.colliding(rows)
    assert sorted(map(tuple, got.collect())) == [("m", 1, 2, "strong"), ("m", 1, 3, "weak"), ("m", 2, 3, "weak")]
    assert not {("a",), ("b",)} & set(map(tuple, exchanged(got)))


def test_versions_bring_their_paths(spark):
    v = [(k, f, k, s) for k, f, s in ((1, "x", "m"), (2, "x", "n"), (3, "x", None), (4, "x", "m"), (5, "x", "m"), (6, None, "m"), (7, "y", "m"), (8, "y", "q"), (9, "y", "q"))]
    p = [(1, "/a", "A"), (1, "/b", "B"), (2, "/a", "A"), (2, "/b", "C"), (3, "/a", "A"), (3, "/c", "B"), (4, "/a", "A"), (4, "/a", "Z"), (7, "/a", "A"), (7, "/b", None), (8, "/a", "R"), (8, "/b", "B"), (9, "/b", "B"), (9, None, "B")]
    versions, paths = spark.createDataFrame(v, "schema_id long, family_id string, version long, sem_id string"), spark.createDataFrame(p, "schema_id long, path string, types string")
    got = semantic.family_drift(versions, paths)
    assert ["pair"] not in exchanged(got) and ["pair", "path"] not in exchanged(got)
    pairs = versions.alias("x").join(versions.alias("y"), F.expr("x.family_id = y.family_id and y.version < x.version")).selectExpr("x.schema_id", "y.schema_id as prior", "concat(x.schema_id, '>', y.schema_id) as pair", "coalesce(x.sem_id <> y.sem_id, false) as moved")
    side = lambda c: pairs.selectExpr("pair", f"{c} as schema_id").join(paths, "schema_id").select("pair", "path", "types")
    plain = pairs.join(semantic.structural_relation(side("schema_id"), side("prior"), "pair"), "pair", "left").selectExpr("schema_id", "prior", "coalesce(relation, 'compatible')", "coalesce(relation, 'compatible') = 'compatible' and moved")
    want = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, got.collect())) == want and len({r[2] for r in want}) == 3 and len(want) == 13
