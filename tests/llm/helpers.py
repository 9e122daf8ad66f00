"""Small tables with nulls, empties, long texts, ties, repeats and clashing extra columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = {"en": ["the", "of", "and", "tion", "ing", "er", "th"], "es": ["el", "ción", "os", "ñar", "que", "ll"], "fr": ["le", "eau", "eux", "é", "oi", "que"]}


def words(rng, n, lang="en"):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 5))) for _ in range(n))


def prose(rng, sentences, lang="en"):
    return " ".join(words(rng, rng.randint(6, 15), lang).capitalize() + "." for _ in range(sentences))


def documents(spark, rows, extra=True):
    """rows: (doc_id, text, lang, source)."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    if not extra:
        return spark.createDataFrame(data, schema)
    # names that the operators use themselves
    return spark.createDataFrame([(*r, "x", 1, 2.0, b"z", 5) for r in data], schema + ", key string, size int, score double, signature binary, root long")


def odd_rows(seed=1):
    rng = random.Random(seed)
    a, b = prose(rng, 12), prose(rng, 9, "es")
    long = prose(rng, 3000)
    return [
        (1, a, "en", "s1"), (2, a, "en", "s1"), (3, a.replace("the", "thx", 1), "en", "s1"), (4, b, "es", "s2"), (5, None, "en", None), (6, "", None, "s2"), (7, " \t\n\x0b ", "en", "s3"),
        (8, long, "en", "s3"), (9, "one", "en", None), (10, "one two three", "en", "s1"), (10, "one two three", "en", "s1"), (11, "x" * 50_000, "fr", "s1"), (12, "é!? 123 $$", "fr", "s4"), (None, a, "en", "s1"),
        (13, "12 34", "en", "s1"), (14, prose(rng, 8, "fr"), "fr", "s2"),
    ]


def write_tables(spark, folder, docs, pages=None, benchmark=None):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    if pages is not None:
        pages.write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    if benchmark is not None:
        benchmark.write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
