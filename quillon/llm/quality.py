"""Quality rules as a short-circuit cascade, in built-in functions only.

Base figures are computed for every document. The further rules form a cascade: a document that fails one isn't shown to the next. Each
rule's cost and rejection rate are measured on a sample, and the rules run by rejection per cost, highest first. The order changes
the work, never the verdict.

Words repeated in 5-word windows: windows are hashed with xxhash64 (two different windows of one text agree with a chance of 2**-64);
the hashes are sorted with their places only in texts that hold some window twice, so the work is n log n for texts of any length.

Defined results: null or empty text has all figures 0 and fails the base rules (under ten words); rows are judged one by one, so repeated
rows and ids agree; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
SAMPLE_ROWS = 2000
SAMPLE_FILES = 4


@dataclass(frozen=True)
class Rule:
    """passes: over the columns that ``base_figures`` gives and ``text``."""

    name: str
    passes: Column


def default_rules() -> list[Rule]:
    n, text = F.col("n_words"), F.col("text")
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return [
        Rule("mean_word_length", (F.col("word_chars") >= 2 * n) & (F.col("word_chars") <= 16 * n)),
        Rule("few_symbols", 10 * F.col("n_symbols") <= n),
        Rule("few_repeated_lines", 10 * F.col("n_dup_lines") <= 3 * lines),
        Rule("not_shouting", 2 * F.regexp_count(text, F.lit(r"\p{Lu}")) <= F.regexp_count(text, F.lit(r"\p{L}"))),
        Rule("words_with_letters", 10 * F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*")) >= 7 * n),
        Rule("few_ellipses", 10 * F.regexp_count(text, F.lit(r"(\.\.\.|…)[\x20\x09\x0D]*(\n|$)")) <= 3 * lines),
        Rule("few_bullets", 10 * F.regexp_count(text, F.lit(r"(^|\n)[\x20\x09]*[•‣▪*-][\x20\x09]")) <= 9 * lines),
    ]


def base_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    d = docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    text = F.col("text")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(common.WORD))
    d = _fixed(d, w=F.array_remove(F.split(F.col("text"), common.SPACE), ""), lines=lines)
    w, text = F.col("w"), F.col("text")
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    d = _fixed(d, windows=F.when(F.size(w) >= 5, window).otherwise(F.array().cast("array<bigint>")))
    v = F.col("windows")
    ranked = F.array_sort(F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = _fixed(d, ranked=F.when(F.size(F.array_distinct(v)) < F.size(v), ranked).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    r = F.col("ranked")
    twice = F.filter(r, lambda x, k: F.coalesce(F.get(r, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(r, k + 1)["h"] == x["h"], F.lit(False)))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])
    figures = {
        "n_words": F.size(w), "word_chars": F.length(F.translate(text, BLANKS, "")), "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "n_repeat_words": covered,
    }
    d = _fixed(d, **{k: c.cast("long") for k, c in figures.items()}).select("doc_id", "text", *figures)
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _fixed(d: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row, which the optimizer doesn't see through: else it would copy their expressions into every lambda and
    filter that uses them, to be evaluated once per array element."""
    one = d.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("fixed__"))
    return one.select(*d.columns, *[F.col(f"fixed__.{k}").alias(k) for k in columns])


def plan_cascade(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The rules by rejection per cost, with the seconds and the rejection rate measured on about ``sample_rows`` rows of ``docs`` (doc_id, text), drawn row by row whatever their ids."""
    total = docs.count()
    if not total or len(rules) < 2:
        return [(r, 0.0, 0.0) for r in rules]
    # the scan keeps all its tasks; only the drawn rows are dealt anew
    drawn = docs.sample(min(1.0, sample_rows / total), seed=5).repartition(SAMPLE_FILES)
    sample = common.written(base_figures(drawn), "quality-sample").filter(~F.col("base_failed"))

    def run(passes: Column) -> tuple[float, float]:
        began = time.perf_counter()
        seen = sample.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~passes, 1)).alias("failed"), F.sum(F.length("text"))).first()
        return time.perf_counter() - began, (seen["failed"] / seen["n"] if seen["n"] else 0.0)

    run(F.lit(True))
    scan = min(run(F.lit(True))[0] for _ in range(2))
    measured = []
    for rule in rules:
        run(rule.passes)  # compiles the code
        seconds, rejected = run(rule.passes)
        measured.append((rule, max(seconds - scan, 1e-4), rejected))
    return sorted(measured, key=lambda x: -x[2] / x[1])


def quality(docs: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the base figures, base_failed, kept, and failed_rule (``base``, the first rule of this run's order that fails, or null)."""
    rules = default_rules() if rules is None else list(rules)
    docs = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    figures = base_figures(docs)
    verdict = F.when(F.col("base_failed"), "base")
    for rule, _, _ in plan_cascade(docs, rules):
        verdict = verdict.when(~rule.passes, rule.name)
    judged = figures.withColumn("failed_rule", verdict)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(F.col("doc_id").alias(id_col), *columns, F.col("failed_rule").isNull().alias("kept"), "failed_rule")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents")).drop("failed_rule")


QUERIES = {"op5_quality_rules": op5_quality_rules}
_CASES = """10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 16 * n_words AND 10 * n_dup_lines <= 3 * n_lines
AND 2 * len(regexp_extract_all(t, '\\p{Lu}')) <= len(regexp_extract_all(t, '\\p{L}'))
AND 10 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}'))) >= 7 * n_words
AND 10 * len(regexp_extract_all(t, '(\\.\\.\\.|…)[\\x20\\x09\\x0D]*(\\n|$)')) <= 3 * n_lines
AND 10 * len(regexp_extract_all(t, '(^|\\n)[\\x20\\x09]*[•‣▪*-][\\x20\\x09]')) <= 9 * n_lines"""
ORACLE_SQL = {
    "op5_quality_rules": f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM a WHERE len(w) >= 5),
v AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g FROM p),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM v),
x AS (SELECT DISTINCT doc_id, i + unnest(range(0, 5)) AS j FROM c WHERE k > 1),
n AS (SELECT doc_id, count(*) AS n_repeat_words FROM x GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM a),
m AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
f AS (SELECT a.doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
len(string_split(t, chr(10))) AS n_lines FROM a LEFT JOIN n ON a.doc_id = n.doc_id LEFT JOIN m ON a.doc_id = m.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_CASES}) AS kept FROM b"""
}
