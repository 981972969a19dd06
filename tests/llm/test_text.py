"""Language identification, licence scans and toxicity."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import langid, licenses, toxicity
from tests.llm.helpers import corpus, documents, sentence

ODD = [None, "", " \n", "12 34 %%", "🎉", "x" * 40_000, "日本語テスト", "a", "İ" * 30]


def test_languages(spark):
    texts, langs = corpus(300)
    docs = documents(spark, texts + ODD + texts[:5], langs + [None] * len(ODD) + [None] * 5, lang_pred="zz", score=2)
    model = langid.fit(*langid.sample(docs, per_language=60))
    rows = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(rows) == len(texts) + len(ODD) + 5
    assert np.mean([rows[i]["lang_pred"] == x for i, x in enumerate(langs)]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    n = len(texts)
    assert [rows[n + i]["lang_pred"] == "und" for i in range(len(ODD))] == [True, True, True, True, True, False, False, False, False]
    assert all(rows[n + len(ODD) + i]["score"] == rows[i]["score"] for i in range(5))
    # A text's score does not hang on its neighbours in a block.
    alone = model.scores([texts[7]])
    assert np.allclose(alone, model.scores([texts[1], texts[7], "x"])[1], atol=1e-5)


def test_kernel_is_that_of_sets_of_letters():
    texts, langs = corpus(60)
    m = langid.fit(texts, langs)
    marks = [t for x in m.languages for t in sorted((t for t, y in zip(texts, langs) if y == x), key=lambda t: abs(len(t) - 1500))[: langid.LANDMARKS]]

    def grams(t, n, known=None):
        low = "".join(c if m.letters[ord(c)] else " " for c in t.lower()) + "  "
        # A gram belongs to the text if its last place is not beyond the text and its end marks.
        g = {low[i : i + n] for i in range(len(low) - n + 1)} - {" " * n}
        return g if known is None else g & known

    for t in texts[:10]:
        expected = np.zeros(len(marks))
        for n in langid.ORDERS:
            known = set().union(*(grams(x, n) for x in marks))
            a = grams(t, n, known)
            for j, x in enumerate(marks):
                b = grams(x, n)
                expected[j] += len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1)) / len(langid.ORDERS)
        assert np.allclose(m.kernel([t])[0], expected, atol=1e-4)


def test_languages_of_many_letters():
    """Each letter of the landmarks counts, also where they have more than any small alphabet."""
    rng = random.Random(12)
    pools = {x: [chr(0x4E00 + 3 * i + k) for i in range(400)] for k, x in enumerate("abc")}
    # The commonest letters are shared; what tells the languages apart are the many others.
    common = [chr(0x6E00 + i) for i in range(180)]
    made = lambda x: "".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(pools[x]) for _ in range(200))
    langs = [rng.choice("abc") for _ in range(400)]
    texts = [made(x) for x in langs]
    m = langid.fit(texts[:250], langs[:250])
    assert m.base > 1000 and len({int(m.letters[ord(c)]) for t in texts[:20] for c in t}) > 500
    assert np.mean([m.languages[i] == x for i, x in zip(m.scores(texts[250:]).argmax(axis=1), langs[250:], strict=True)]) > 0.97


def test_numerals_are_no_letters(spark):
    texts, langs = corpus(80)
    odd = ["½ ² Ⅷ", "①②③ 12", "\U00020000\U00020001", "² water"]
    docs = documents(spark, texts + odd, langs + [None] * 4)
    rows = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(*langid.sample(docs))).collect()}
    assert [rows[len(texts) + i]["lang_pred"] == "und" for i in range(4)] == [True, True, False, False]
    assert [rows[len(texts) + i]["score"] for i in range(2)] == [0.0, 0.0]


def test_no_labels(spark):
    docs = documents(spark, ["abc", None])
    rows = langid.predict(docs, langid.fit(*langid.sample(docs))).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), None).count() == 0


def test_held_out_languages(spark, small):
    got = langid.op6_langid(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scanned(text):
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    hits = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark):
    rng = random.Random(2)
    texts, _ = corpus(60)
    pool = ["cc", "BY", "by", "general", "Public", "license", "all", "rights", "reserved", "é", "-", ".", "the", "MIT", "4.0"]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    planted = {"Released under the MIT License.": "mit", "x y Licensed under the Apache License, Version 2.0. z": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "ALL RIGHTS RESERVED": "reserved"}
    n = len(texts)
    texts += [texts[3] + "\n" + p for p in planted] + [None, "", "\n", "license " * 8_000, "all rights reserved " * 3_000, "ÄLL RIGHTS RESERVED"]
    rows = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts, labels="x", n_words=0)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == scanned(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert [rows[n + i]["labels"] for i in range(len(planted))] == list(planted.values())
    assert all(rows[i]["labels"] == "" for i in range(60))
    assert licenses.scan(documents(spark, ["x"]).limit(0)).count() == 0


def aligned(index, words):
    """Labels and score of all alignments at all shifts, by definition."""
    labels, best = set(), 0.0
    for t, ws in enumerate(index.words):
        for shift in range(1 - len(ws), len(words)):
            share = sum(index.idf[w] for q, w in enumerate(ws) if 0 <= q + shift < len(words) and words[q + shift] == w) / index.weight[t]
            span = words[max(0, shift) : max(0, shift) + len(ws) + 4]
            if share >= licenses.COVERED and any(span[i : i + len(k)] == k for k in index.keys[t] for i in range(len(span))):
                labels.add(index.labels[t])
                best = max(best, share)
    return labels, best


def test_several_notices(spark):
    """Every notice of a file counts, whatever other notices and scattered licence words it holds."""
    rng = random.Random(7)
    prose, _ = corpus(300)
    notices = [t[1] for t in licenses.TEMPLATES]
    scattered = [w for n in notices for w in n.split()]
    picks = [(a, b) for a in range(len(notices)) for b in range(len(notices)) if a != b] + [tuple(range(len(notices)))] + [tuple(rng.sample(range(len(notices)), 5)) for _ in range(40)]
    texts = [". ".join(x for i in pick for x in (notices[i], rng.choice(prose))) for pick in picks]
    texts += [" ".join(rng.sample(scattered, len(scattered))) + " " + n for n in notices] + [" ".join(rng.choice(scattered) for _ in range(200)) for _ in range(20)]
    docs = documents(spark, texts + prose)
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    total, df = licenses.document_frequency(docs)
    index = licenses.Index(licenses.TEMPLATES, {w: np.log((1 + total) / (1 + n)) + 0.05 for w, n in df.items()})
    for i, pick in enumerate(picks):
        assert {licenses.TEMPLATES[j][0] for j in pick} <= set(rows[i]["labels"].split(",")), texts[i]
    for i, n in enumerate(licenses.TEMPLATES):
        assert n[0] in rows[len(picks) + i]["labels"].split(","), n[0]
    for i in range(len(picks) - 41, len(texts)):
        labels, score = aligned(index, licenses.split(texts[i]))
        base = set(filter(None, rows[i]["base_labels"].split(",")))
        assert set(filter(None, rows[i]["labels"].split(","))) == labels | base
        assert abs(rows[i]["score"] - min(1, max(score, licenses.COVERED if base else 0))) < 1e-9


def edited_notices(rng, edit):
    """For each licence with several passages: its text, edited."""
    by = {}
    for label, passage, _ in licenses.TEMPLATES:
        by.setdefault(label, []).append(passage)
    return [(label, edit(". ".join(ps).split(" "), rng)) for label, ps in by.items() if sum(len(p.split()) for p in ps) >= 20]


def _wrapped(words, rng):
    return "".join(w + ("\n// * " if i % 9 == 8 else " ") for i, w in enumerate(words))


def _cut(words, rng):
    return " ".join(words[: len(words) // 2])


def _replaced(words, rng):
    return " ".join("other" if rng.random() < 0.08 else w for w in words)


def _shifted(words, rng):
    return " ".join(w + (" indeed" if rng.random() < 0.05 else "") for w in words if rng.random() > 0.03)


@pytest.mark.parametrize("edit,least", [(_wrapped, 1.0), (_cut, 1.0), (_replaced, 0.9), (_shifted, 0.85)])
def test_recall_on_edited_notices(edit, least):
    rng = random.Random(4)
    prose, _ = corpus(200)
    index = licenses.Index(licenses.TEMPLATES, dict.fromkeys((w for t in licenses.TEMPLATES for w in licenses.split(t[1])), 5.0))
    cases = [c for _ in range(8) for c in edited_notices(rng, edit)]
    hit = [label in index.scan(licenses.split(rng.choice(prose) + "\n" + text + "\n" + rng.choice(prose)))[4] for label, text in cases]
    assert np.mean(hit) >= least
    assert not any(index.scan(licenses.split(t))[4] for t in prose)


def test_document_frequencies(spark):
    texts = ["The MIT license, the MIT License", None, "license\x0bMIT", "", "éMIT mit\u00e9"]
    n, df = licenses.document_frequency(documents(spark, texts))
    assert n == 5
    for w in df:
        assert df[w] == sum(w in licenses.split(t or "") for t in texts), w


def test_license_query_by_definition(spark, small):
    """The query's rows against every alignment at every shift, on whole texts."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    total, df = licenses.document_frequency(docs)
    index = licenses.Index(licenses.TEMPLATES, {w: np.log((1 + total) / (1 + n)) + 0.05 for w, n in df.items()})
    rows = {r["doc_id"]: r for r in licenses.op7_licenses(spark, small).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == scanned(t)
        if len(t) < 6_000:
            labels, _ = aligned(index, licenses.split(t))
            assert set(filter(None, r["labels"].split(","))) == labels | set(filter(None, r["base_labels"].split(",")))


def toxic_corpus(n=500):
    rng = random.Random(6)
    stems = ["scumb", "vlorp", "krazt"]
    texts, labels = [], []
    for i in range(n):
        words = sentence(rng.choice(["en", "de", "fr"]), rng.randint(5, 150), rng).split()
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "s", "er", "ung", "ment", "y", "est", "ling"]))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_toxicity(spark):
    texts, labels = toxic_corpus()
    all_ = texts + ODD + ["water " * 20_000 + "vlorpious", texts[0]]
    docs = documents(spark, all_, score=9, predicted=9)
    marks = spark.createDataFrame(list(enumerate(labels)) + [(3, None)], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.sample(docs, marks))
    rows = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(rows) == len(all_) and all(0 <= s <= 1 for s in rows.values())
    held = [i for i in range(len(texts)) if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    right = [(rows[i] >= 0.7) == (labels[i] == 1) for i in held]
    assert np.mean(right) > 0.97
    assert rows[len(all_) - 2] >= 0.7  # an unseen ending in a long text
    assert rows[len(all_) - 1] == rows[0]
    assert max(rows[len(texts) + i] for i in range(5)) < 0.7
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.fit(*toxicity.sample(docs, marks.where("toxic = 0")))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.0}


def plain_score(model, text):
    """The score term by term: a word's bag, a text's weighted average, the level."""
    odds = [np.mean([model.odds[b] for w, b in zip(*toxicity.subwords([word])) if w == 0]) for word in dict.fromkeys(toxicity.WORD.findall((text or "").lower()))]
    share = [np.exp(toxicity.SHARPNESS * x) for x in odds]
    mean = sum(s * x for s, x in zip(share, odds)) / sum(share) if odds else 0.0
    slope, length, start = model.levels
    return 1 / (1 + np.exp(-(slope * mean + length * np.log(1 + len(odds)) + start)))


def test_toxicity_query_scores_whole_texts_by_definition(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(*toxicity.sample(docs, spark.read.parquet(f"{small}/labels.parquet")))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = toxicity.op10_toxicity(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert abs(r["score"] - plain_score(model, texts[r["doc_id"]])) < 1e-6
        assert r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (__import__("zlib").crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_length_alone_is_not_toxic():
    """Clean texts of any length score alike, and training the vectors beats their start."""
    texts, labels = toxic_corpus(700)
    rng = random.Random(3)
    clean = {n: [" ".join(sentence("en", n, rng).split()) for _ in range(60)] for n in (8, 60, 500, 3_000)}
    model = toxicity.fit(texts[:500], np.array(labels[:500]))
    words = lambda ts: [toxicity.words_of(t) for t in ts]
    score = lambda m, ts: m.score(m.words([w for ws in words(ts) for w in ws]), np.array([len(ws) for ws in words(ts)]))
    assert all((score(model, ts) >= toxicity.CUT).mean() <= 0.02 for ts in clean.values())
    y = np.array(labels[500:])
    loss = lambda m: -np.log(np.clip(np.where(y == 1, score(m, texts[500:]), 1 - score(m, texts[500:])), 1e-9, 1)).mean()
    assert loss(toxicity.train(texts[:500], np.array(labels[:500]))) < loss(toxicity.train(texts[:500], np.array(labels[:500]), rounds=0))
