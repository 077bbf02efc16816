"""Operator 6: quality rules whose thresholds follow each language and source.  DataFrame functions only.

`base_stats` counts, in one row-local expression, words, marks, repeated lines and repeated five-word windows.
`sketches` holds each rule's distribution per (language, source) over the documents that pass the base rule, as counts
on a fixed grid: a quantile sketch that merges by adding counts, has at most 1001 cells and errs by at most one cell.
A rule's fence is read off the sketch: from its upper quantile, which most documents stay below, the distance to the
median is stepped off a few times more, and one cell for the grid. Shares of repeated lines and words, most of which
are 0 and few of which spread as far as they can, have no steps: their fence is the quantile itself, so it never lies
beyond what the group's documents reach, nor beyond the base rule. Every source's fence is drawn towards that of its
language, and a language's towards that of all documents, as if SHRINK further documents had that one: so a small
source has nearly its language's fence, a large one its own, and no size switches between them. The small table of
fences is joined to the documents by language and source; one is kept if it passes all its fences and the base rule.

Null text has no words and fails the base rule, as do empty texts; null lang and source are groups of their
own. Repeated rows are kept apart and counted as often as they occur. Only doc_id, text, lang and source are
read, so further columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CHARS, discard, let, stage, words

WINDOW = 5
#: Rule, its value on the grid (SQL of both engines, but for the division), upper quantile in thousandths, and the steps
#: of the distance from the median to it that a document may lie beyond it.
RULES = {
    "marks": ("n_marks * 1000", "word_chars", 900, 5),
    "capitals": ("n_capitals * 1000", "word_chars", 900, 6),
    "long_words": ("word_chars * 10", "n_words", 900, 6),
    "dup_lines": ("n_dup_lines * 1000", "n_lines", 996, 0),
    "repeats": ("n_repeat_words * 1000", "n_words", 996, 0),
}
SHRINK = 200
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeat_words(word: Column) -> Column:
    """Words in windows of five that the text has twice or more. Windows are compared by 64-bit hashes."""

    def covered(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)

    def twice(s: Column) -> Column:
        """s: (hash, position) in order; those with an equal neighbour."""
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return let(F.array_sort(F.transform(at, lambda i: F.get(s, i)["p"])), covered)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), twice)).otherwise(0)

    windows = F.transform(F.sequence(F.lit(0), F.size(word) - WINDOW), lambda i: F.xxhash64(*(F.get(word, i + k) for k in range(WINDOW))))
    return F.when(F.size(word) < WINDOW, 0).otherwise(let(windows, count))


def base_stats(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, lang, source, further columns asked for, and the counts of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), *more, text.alias("text"))
    given, text = [c for c in one.columns if c != "text"], F.col("text")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    counted = one.select(
        *given,
        _without(text, SPACE_CHARS).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.length(text) - _without(text, CAPITALS)).cast("long").alias("n_capitals"),
        (F.length(text) - _without(text, MARKS)).cast("long").alias("n_marks"),
        let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"),
    )
    return counted.select(*(c for c in counted.columns if c not in "wl"), "w.*", "l.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def on_grid(rule: str) -> Column:
    top, bottom, *_ = RULES[rule]
    return F.expr(f"least({top} div greatest({bottom}, 1), 1000)")


def sketches(stats: DataFrame) -> DataFrame:
    """Counts per level, lang, source, rule and value; level 0 has lang and source, 1 lang only, 2 neither."""
    cells = stats.where(~base_failed()).select("lang", "source", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), on_grid(r).alias("value")) for r in RULES))).alias("c"))
    fine = cells.groupBy("lang", "source", "c.rule", "c.value").agg(F.count(F.lit(1)).alias("n"))
    merged = lambda level, *keys: fine.groupBy(*keys, "rule", "value").agg(F.sum("n").alias("n")).withColumn("level", F.lit(level))
    return fine.withColumn("level", F.lit(0)).unionByName(merged(1, "lang"), allowMissingColumns=True).unionByName(merged(2), allowMissingColumns=True)


def fences(sketch: DataFrame) -> DataFrame:
    """The highest value that passes by its own sketch, per level, lang, source and rule, and the sketch's total."""
    group = Window.partitionBy("level", "lang", "source", "rule")
    ranked = sketch.withColumn("below", F.sum("n").over(group.orderBy("value"))).withColumn("total", F.sum("n").over(group))
    of_rule = lambda i: F.create_map(*(F.lit(x) for r, v in RULES.items() for x in (r, v[i])))[F.col("rule")]
    quantile = lambda share: F.min(F.when(F.col("below") * 1000 >= F.col("total") * share, F.col("value")))
    at = ranked.groupBy("level", "lang", "source", "rule").agg(F.max("total").alias("total"), quantile(of_rule(2)).alias("upper"), quantile(F.lit(500)).alias("middle"))
    return at.select("level", "lang", "source", "rule", "total", (F.col("upper") + of_rule(3) * (F.col("upper") - F.col("middle")) + 1).alias("fence"))


def thresholds(stats: DataFrame) -> DataFrame:
    """A row for each language and source: the fence of each rule, drawn towards those of the merged sketches."""
    found = fences(sketches(stats))
    level = lambda n: found.where(F.col("level") == n)
    a = level(0).select("lang", "source", "rule", F.col("total").alias("n0"), F.col("fence").alias("f0"))
    b = level(1).select(F.col("lang").alias("lang1"), F.col("rule").alias("rule1"), F.col("total").alias("n1"), F.col("fence").alias("f1"))
    c = level(2).select(F.col("rule").alias("rule2"), F.col("fence").alias("f2"))
    both = a.join(b, F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("rule") == F.col("rule1"))).join(c, F.col("rule") == F.col("rule2"))
    drawn = both.withColumn("f1", F.expr(f"(n1 * f1 + {SHRINK} * f2) div (n1 + {SHRINK})")).withColumn("fence", F.expr(f"(n0 * f0 + {SHRINK} * f1) div (n0 + {SHRINK})"))
    return drawn.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", "fence"))).alias("fences"))


def _limits(stats: DataFrame) -> DataFrame:
    """thresholds of the (written) counts, written down."""
    return stage(thresholds(stats).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "fences"), "fences")


def _verdicts(stats: DataFrame, limit: DataFrame) -> DataFrame:
    both = stats.join(limit, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    passes = F.lit(True)
    for rule in RULES:
        passes &= on_grid(rule) <= F.col("fences")[rule]
    return both.select(*stats.columns, base_failed().alias("base_failed"), (~base_failed() & passes).alias("kept"))


def judged(docs: DataFrame, *more: Column) -> DataFrame:
    """Counts and verdict of each document, and further columns asked for."""
    stats = stage(base_stats(docs, *more), "stats")
    return _verdicts(stats, _limits(stats))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are kept. Counts are made again beside each row, so neither rows nor counts stay
    on disk until the result is written."""
    stats = stage(base_stats(docs), "stats")
    limit = _limits(stats)
    discard(stats)
    return _verdicts(base_stats(docs, F.struct(*docs.columns).alias("_qr_row")), limit).where("kept").select("_qr_row.*")
