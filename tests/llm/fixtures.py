"""Small documents with what operators must stand: nulls, empty and long texts, copies, repeated rows, clashing names."""

import random

WORDS = {
    "en": "the of and to in that is was for with his they this have from or had by but some what there".split(),
    "de": "der die und das nicht ist ein ich wir auch für über können schön groß straße mädchen haben sein werden".split(),
    "fr": "le la les et être à une pour dans qui avec sont pas plus où été même très français élève garçon".split(),
}

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, tag int, bucket string, shard string, block int"


def text_of(rng, lang, n):
    made = (rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en", str(rng.randrange(50))]) for _ in range(n))
    return " ".join(w.capitalize() + rng.choice(["", "", ".\n", ","]) if rng.random() < 0.1 else w for w in made)


def texts(seed=1, n=60):
    """(text, lang) with copies, near copies and shared passages in later documents."""
    rng = random.Random(seed)
    out = [(text_of(rng, lang, rng.randrange(20, 120)), lang) for lang in WORDS for _ in range(n // 3)]
    for i in range(0, n, 7):
        t, lang = out[i]
        words = t.split(" ")
        words[len(words) // 2] += "x"
        out += [(t, lang), (" ".join(words), lang), (f"{text_of(rng, lang, 30)} {t[10:120]} {text_of(rng, lang, 30)}", lang)]
    return out


def documents(spark, more=()):
    rows = [(i, t, lang, f"s{i % 3}", len(t)) for i, (t, lang) in enumerate(texts())]
    n = len(rows)
    long = " ".join(t for t, _ in texts(seed=5)) * 8
    rows += [(n, None, "en", None, None), (n + 1, "", "en", "s", 0), (n + 2, " \t\n ", None, "s", 4), (n + 3, long, "en", "s", len(long)), (n + 4, "12345 !!! ###", "en", "s", 13), (n + 5, "one", None, "s", 3)]
    rows += [(n + 6, "naïve ▁ café 中文字   tail  \x00 end ", "fr", "s", 10), (n + 7, "a" * 300, "en", "s", 300), (n + 8, "a" * 200, "en", "s", 200), (n + 9, "it's they'll \n\n  two   spaces\n", "en", "s", 30)]
    rows += [rows[0], rows[0], (None, rows[3][1], "en", "s", 1), (None, "no key at all here", "en", "s", 1)]
    rows += list(more)
    return spark.createDataFrame([(*r, "k", "f", 1, "b", "h", 2) for r in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
