"""Small tables with the cases that every operator has to bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hit string, key long, size long"


def docs(spark, rows, schema=DOCS):
    """rows: (doc_id, text[, source]); the columns hit, key and size clash with names that operators use."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 7, -1) for r in rows]
    return spark.createDataFrame(full, schema)


def words(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def hard_rows():
    """Nulls, empty and very long texts, equal rows, equal texts and odd spacing."""
    base = words(1, 60)
    return [
        (1, base),
        (1, base),
        (2, base),
        (3, None),
        (4, ""),
        (5, "   \n\t "),
        (6, words(2, 30_000, 5000)),
        (7, "one two three"),
        (8, "one two three"),
        (9, base.replace(" ", "  \n")),
        (10, "é ß 日本 \u00a0x\u2028y " + base),
        (None, base),
        (None, None),
        (12, words(3, 20) + " " + base[: len(base) // 2] + " " + words(4, 20)),
    ]
