"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

from pyspark.sql import functions as F

#: Names that operators use for their own columns.
CLASHING = [
    "id", "row", "run", "n", "key", "second", "digest", "entry", "doc", "tag", "set", "region", "size", "src", "block",
    "n_words", "n_tokens", "ids", "kept", "keep_id", "component_id", "score", "host", "payload", "label", "parts",
]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n, size=400):
    return ["".join(rng.choices(LETTERS, k=3)) + str(rng.randrange(size)) for _ in range(n)]


def texts(seed=1, groups=12):
    """Texts with exact copies, near copies, shared passages and odd ones."""
    rng = random.Random(seed)
    passage = words(rng, 45)
    found = [None, "", " \t\n", "one", "one two three", "One TWO three", "x" * 5000, "é ß 漢字 \x00 end", "١٢٣ 456 ...",
             " ".join(words(rng, 20000)), " ".join(["same"] * 300)]
    for _ in range(groups):
        base = words(rng, rng.randrange(5, 200))
        found.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "other", "word"])
            found.append(rng.choice([" ", "\n", "  "]).join(copy))
        if rng.random() < 0.5:
            at = rng.randrange(len(base))
            found.append(" ".join(base[:at] + passage[:rng.randrange(15, 45)] + words(rng, 30)))
    found += rng.sample(found, 8)
    return found


def documents(spark, seed=1, repeated=False, odd_ids=False, parts=5):
    """(doc_id, text, lang, source, n_chars) and the clashing columns, in shuffled order."""
    rng = random.Random(seed + 100)
    rows = [
        (i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", "ü", None]), len(t or ""))
        for i, t in enumerate(texts(seed))]
    if repeated:
        rows += rng.sample(rows, 6)
        rows += [(rows[20][0], "another text of an identifier", "en", "a", 5)]
    if odd_ids:
        rows += [(None, "no identifier", None, None, 3), (None, rows[15][1], None, None, 3), (None, None, None, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.repartition(parts).select("*", *[F.lit(7).alias(c) for c in CLASHING])


def empty(spark, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([], schema)
