import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def documents(spark, texts, langs=None, **extra):
    rows = [(i, t, langs[i] if langs else None, None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


LANGS = {
    "en": "the and of to in that it with from ing tion house water light never under".split(),
    "de": "der und die das nicht mit ist ein für über straße größe wörter keit ung schön".split(),
    "fr": "le la et les des une qui est dans été élève où façon très aux eau tion".split(),
}


def sentence(lang, n, rng):
    w = LANGS[lang]
    return " ".join(rng.choice(w) + (rng.choice(w) if rng.random() < 0.4 else "") for _ in range(n))


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    langs = [rng.choice(list(LANGS)) for _ in range(n)]
    return [sentence(x, rng.randint(5, 60), rng) for x in langs], langs
