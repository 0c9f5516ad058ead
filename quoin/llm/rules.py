"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule rejects documents whose feature lies above a cutoff. The rules' cutoffs are levels: level k takes
the k-th cutoff of every rule, the mildest first, and rejects what any of them rejects, so levels are nested
and one number says from which level on a document goes. Labelled documents, which no rule was fitted on,
test the levels of each stratum: with n distinct texts of label 1, g of them rejected, the exact binomial
probability of g or fewer under a false-rejection rate of ``alpha`` must be at most ``delta`` / strata
(Bonferroni). Levels are tested from the mildest on and testing stops at the first that fails; a fixed
sequence needs no further correction, so with probability 1 - delta no stratum loses more than a share
``alpha`` of its good documents. Among the passed, a stratum takes the level that rejects most texts of
label 0 net of those of label 1, or none if none gains. As copies are one trial but near copies several,
the guarantee is for texts drawn independently. The least n that can pass is
ln(delta / strata) / ln(1 - alpha): 144 with four strata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, row_key, table

SPACES = r"[\x20\x09-\x0D]+"
#: Rule: the feature (larger is worse) and its cutoffs, mildest first; all rules have equally many.
RULES = {
    "repeated": ("n_repeat_words / greatest(n_words, 1)", [0.5, 0.48, 0.46, 0.44, 0.42, 0.4, 0.38, 0.36, 0.34, 0.32, 0.3, 0.28]),
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.16, 0.13, 0.1, 0.08, 0.06, 0.05, 0.04]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35]),
    "capitals": ("n_capitals / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "marks": ("n_marks / greatest(word_chars, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.16, 0.13, 0.1, 0.08, 0.06, 0.05, 0.04]),
    "long_words": ("word_chars / greatest(n_words, 1)", [80.0, 60.0, 50.0, 40.0, 35.0, 30.0, 26.0, 23.0, 20.0, 18.0, 16.0, 14.0]),
}
LEVELS = len(RULES["repeated"][1])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, row_key, text_key, the counts of each whole text, and the level it is rejected from.

    Words and windows stay in arrays of their row: nothing is exploded or shuffled. Windows are 64-bit
    hashes; only texts with a repeated one sort them with their places, and each repeated place covers
    what the one before has not.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"),
        row_key().alias("row_key"),
        F.xxhash64(text).alias("text_key"),
        text.alias("text"),
        F.array_remove(F.split(text, SPACES, -1), "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    windows = F.when(F.size("words") > 2, F.expr("transform(slice(words, 1, size(words) - 2), (x, i) -> xxhash64(x, words[i + 1], words[i + 2]))")).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id",
        "stratum",
        "row_key",
        "text_key",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    base = base.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.expr("transform(windows, (x, i) -> named_struct('h', x, 'i', i))")),
        ),
    )
    repeated = F.expr("filter(transform(sorted, (x, k) -> if(x.h = get(sorted, k + 1).h or x.h = get(sorted, k - 1).h, x.i, null)), x -> x is not null)")
    base = base.withColumn("places", F.sort_array(F.when(F.col("sorted").isNotNull(), repeated)))
    covered = F.expr("aggregate(places, named_struct('n', 0L, 'last', -3), (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x), a -> a.n)")
    base = base.withColumn("n_repeat_words", F.coalesce(F.when(F.col("places").isNotNull(), covered), F.lit(0).cast("long"))).drop("windows", "sorted", "places")
    # how many cutoffs of a rule the value exceeds; as they fall, these are its last ones
    over = [F.size(F.filter(F.array(*map(F.lit, grid)), _below(value))) for value, grid in RULES.values()]
    return base.withColumn("level", F.lit(LEVELS) - F.greatest(*over))


def _below(value: str):
    return lambda c: c < F.expr(value)


def levels(counts: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """The chosen level of each stratum that has one: stratum, chosen."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = counts.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").join(known, "doc_id")
    texts = rows.groupBy("stratum", "text_key").agg(F.min("quality").alias("quality"), F.min("level").alias("level"))
    tallies = materialize(texts.groupBy("stratum", "level", "quality").count(), "tallies")
    n_strata = max(1, tallies.agg(F.countDistinct("stratum")).first()[0])
    # at most twice as many tallies as levels for each stratum
    strata = tallies.groupBy("stratum").agg(
        F.sum(F.when(F.col("quality") == 1, F.col("count")).otherwise(0)).alias("n"),
        F.collect_list(F.struct("level", "quality", "count")).alias("tally"),
    )
    tested = strata.select("stratum", "n", "tally", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("k"))
    count = "aggregate(filter(tally, t -> t.level <= k and t.quality = {}), 0L, (a, t) -> a + t.count)"
    tested = tested.withColumns({"good": F.expr(count.format(1)), "bad": F.expr(count.format(0)), "alpha": F.lit(alpha)})
    term = "if(i = 0, a.t, a.t + ln((n - i + 1) / i) + ln(alpha / (1 - alpha)))"
    tail = F.expr(
        "aggregate(sequence(0L, good), named_struct('t', n * ln(1 - alpha), 's', 0D), "
        f"(a, i) -> named_struct('t', {term}, 's', a.s + exp({term})), a -> a.s)"
    )
    fails = F.when((F.col("n") == 0) | (F.col("good") > F.col("n") * F.col("alpha")), 1).otherwise((tail > F.lit(delta / n_strata)).cast("int"))
    order = W.partitionBy("stratum").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    passed = tested.withColumn("fails", fails).withColumn("failed", F.max("fails").over(order)).where("failed = 0 and bad > good")
    chosen = passed.groupBy("stratum").agg(F.min_by("k", F.struct((F.col("good") - F.col("bad")).alias("net"), "k")).alias("chosen"))
    # a stratum needs hundreds of labelled rows to get a level, so there are few; more are joined by a shuffle
    chosen = materialize(chosen, "levels")
    return F.broadcast(chosen) if chosen.count() <= 10_000 else chosen


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """Counts and verdict for each document.

    docs: ``doc_id``, ``text``, ``lang`` (the stratum); labels: ``doc_id``, ``quality``; other columns
    are not read. Null and empty texts have no words and fail the base rule; a null language is a stratum
    of its own; null ids have no label; a document with several labels counts by the smallest; repeated
    rows are judged alike; with no or few labels no level passes and only the base rule rejects; an
    empty table gives no row.
    """
    counts = materialize(features(docs), "rules")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    hit = F.coalesce(F.col("level") <= F.col("chosen"), F.lit(False))
    return counts.join(levels(counts, labels, alpha, delta), "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~hit).alias("kept"), "row_key",
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_key")
