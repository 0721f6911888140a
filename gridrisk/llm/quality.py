"""Quality rules with adaptive thresholds: log-linear quantile sketches by language and source give each group its fences.

A sketch is a table of counts by bucket. A value is scaled to an integer; up to 127 it is its own bucket, beyond that its
seven leading bits are kept, so a bucket is at most 1/64 of its value wide. Sketches merge by adding counts, which
gives those of a language or of all documents from those of its groups. All of it is DataFrame work on integers, the
same however rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SPACE = r"[ \\x09-\\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: metric: (numerator, denominator, scale to integers, least spread in scaled units, fences that apply)
METRICS = {
    "word_length": ("word_chars", "n_words", 100, 100, ("low", "high")),
    "symbols": ("n_symbols", "n_words", 1000, 50, ("high",)),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 100, ("high",)),
    "repeats": ("n_repeat_words", "n_words", 1000, 50, ("high",)),
}

FENCES = [f"{kind}_{metric}" for metric, (*_, kinds) in METRICS.items() for kind in kinds]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text has none of anything; repeated rows count each for itself; an empty table gives no rows. Windows of
    three words are compared by their 64-bit hashes, which differ for different windows of one text but for a chance
    of about (words / 6e9) squared.
    """
    of = ["doc_id", "lang", "source"]
    t = docs.select(*of, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.select(
        *of,
        F.expr(f"filter(split(text, '{SPACE}+'), w -> w != '')").alias("words"),
        F.expr(f"regexp_count(text, '{SYMBOLS}')").alias("n_symbols"),
        F.expr(f"filter(split(text, '\\n'), l -> l rlike '[^ \\\\x09-\\\\x0D]')").alias("lines"),
    )
    t = t.select(
        *of,
        "n_symbols",
        F.size("words").alias("n_words"),
        F.expr("char_length(array_join(words, ''))").alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr("if(size(words) > 2, transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])), cast(array() as array<bigint>))").alias("windows"),
    )
    t = t.withColumn("again", F.expr("if(size(array_distinct(windows)) = size(windows), cast(array() as array<struct<w:bigint,i:int>>), array_sort(transform(windows, (w, i) -> struct(w, i))))"))
    t = t.withColumn("again", F.expr("sort_array(transform(filter(again, (x, k) -> coalesce(get(again, k - 1).w = x.w, false) or coalesce(get(again, k + 1).w = x.w, false)), x -> x.i))"))
    t = t.withColumn("n_repeat_words", F.expr("aggregate(transform(again, (i, k) -> least(3, coalesce(get(again, k + 1) - i, 3))), 0, (a, x) -> a + x)"))
    return t.select("doc_id", "lang", "source", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])


def scaled(metric: str) -> Column:
    """The metric of a text as an integer; 0 where there is nothing to divide by."""
    up, down, scale, *_ = METRICS[metric]
    return F.when(F.col(down) > 0, F.expr(f"{up} * {scale} div {down}")).otherwise(F.lit(0)).cast("long")


def bucket(v: Column) -> Column:
    """The smallest value of v's bucket."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - 7)
    power = F.pow(F.lit(2.0), shift).cast("long")
    return v - v % power


def sketches(measured: DataFrame, group: list[str]) -> DataFrame:
    """Counts by group, metric and bucket, of texts that have words."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(scaled(m)).alias("bucket")) for m in METRICS]))
    return measured.where(F.col("n_words") > 0).select(*group, values.alias("v")).groupBy(*group, "v.metric", "v.bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, group: list[str]) -> DataFrame:
    return sketch.groupBy(*group, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, group: list[str], reach: int = 4) -> DataFrame:
    """A row for each group: n_texts, and for each metric low_METRIC and high_METRIC, `reach` spreads beyond the quartiles.

    The spread is the distance between the quartiles, or the metric's least spread if that is more.
    """
    by = Window.partitionBy(*group, "metric")
    c = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("all", F.sum("n").over(by))
    q = c.groupBy(*group, "metric").agg(F.max("all").alias("n_texts"), F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bucket"))).alias("q1"), F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("bucket"))).alias("q3"))
    own = lambda m, what: F.max(F.when(F.col("metric") == m, what))
    columns = []
    for m, (*_, least, kinds) in METRICS.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * reach
        columns += [own(m, F.col("q1") - spread).alias(f"low_{m}")] * ("low" in kinds) + [own(m, F.col("q3") + spread).alias(f"high_{m}")] * ("high" in kinds)
    return q.groupBy(*group).agg(F.max("n_texts").alias("n_texts"), *columns)


def shrunk(n: str, own: str, wider: str, prior_texts: int) -> Column:
    """The mean of a group's fence, weighing as its texts, and of the wider group's, weighing as prior_texts; the wider one without the own."""
    return F.coalesce((F.col(n) * F.col(own) + F.lit(float(prior_texts)) * F.col(wider)) / (F.col(n) + float(prior_texts)), F.col(wider))


def rules(sketch: DataFrame, prior_texts: int) -> DataFrame:
    """lang, source and the fences that hold for them, from the sketches by lang and source."""
    groups = fences(sketch, ["lang", "source"])
    langs = fences(merge(sketch, ["lang"]), ["lang"])
    everything = fences(merge(sketch, []), []).select(*[F.col(c).alias(f"all_{c}") for c in FENCES])
    langs = langs.crossJoin(F.broadcast(everything)).select(F.col("lang").alias("of_lang"), *[shrunk("n_texts", c, f"all_{c}", prior_texts).alias(f"lang_{c}") for c in FENCES])
    joined = groups.join(langs, F.col("lang").eqNullSafe(F.col("of_lang")))
    return joined.select(F.col("lang").alias("rule_lang"), F.col("source").alias("rule_source"), *[shrunk("n_texts", c, f"lang_{c}", prior_texts).alias(c) for c in FENCES])


def judge(docs: DataFrame, prior_texts: int = 100, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """What measure() gives, with base_failed and kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in repeated windows. kept: not
    base_failed, and each metric is within the fences of the text's (lang, source). A group's fences are drawn towards
    those of its lang as by prior_texts more texts, and a lang's likewise towards those of all texts, so that small
    groups lean on larger ones without a step. A null lang or source is a group like any other.
    """
    m = common.settle(measure(docs), "measured")
    fenced = common.settle(rules(common.settle(sketches(m, ["lang", "source"]), "sketches"), prior_texts), "rules")
    same = F.col("lang").eqNullSafe(F.col("rule_lang")) & F.col("source").eqNullSafe(F.col("rule_source"))
    j = m.join(common.small(fenced, 200_000), same, "left").drop("rule_lang", "rule_source")
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    within = F.lit(True)
    for c in FENCES:
        kind, metric = c.split("_", 1)
        within = within & F.coalesce(scaled(metric) >= F.col(c) if kind == "low" else scaled(metric) <= F.col(c), F.lit(True))
    return j.withColumn("base_failed", base).withColumn("kept", ~base & within)
