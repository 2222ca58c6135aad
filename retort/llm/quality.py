"""Quality rules with thresholds that follow the data, with DataFrame functions only.

Each document gets a few measures: how many of its parts are of a kind (symbols of its characters, repeats of its lines, ...). A
mergeable quantile sketch is kept for each language, source and measure, of the rates and of the sizes they are taken of: values fall in
buckets that grow by a constant factor (rates of zero in one of their own), and a sketch is the count of each bucket, so that sketches of
parts merge by adding counts (a plain ``groupBy`` with map-side combination, whatever the size of a group) and every quantile is within a
fixed relative error.

The fence of a group and measure is a rate. It lies above the median rate by ``REACH`` times the distance from the lower quartile to the
median (poor texts stretch the upper side only, so they hardly move it), and at least ``ERRORS`` sampling errors above the median, for a text of the
median size: where all are alike, or most rates are zero, quartile and median are equal, and this distance is the fence. A
document is rejected if its rate is beyond the fence by ``ERRORS`` sampling errors of its own. Errors are those of counts, on whose square
roots they are about a half each whatever the rate; so a count of zero is never beyond a fence, and a short text needs a higher rate than a long
one. Groups are pooled with the whole: median and quartile are the means of the group's and of all documents', weighed by the group's
documents and by ``PRIOR_ROWS``. No fixed cutoff holds a fence. A document that fails a base rule or lies beyond a fence is rejected.

Defined cases: a null text is a text without words, which the base rule rejects and the sketches leave out; null languages and
sources form groups of their own; a group of one row, or of equal rows, has fences mostly from the whole and from the least distance; equal
rows get equal verdicts; a text that is one word of any length is measured like others; names of further columns do not matter, as the given
row travels in a column of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.common import SPACE_CHARS, checkpointed, joined_hashes, words, written

#: Ratio of neighbouring bucket bounds of the sketch: quantiles are right to 2 %.
GROWTH = 1.02
#: Bucket of rates of zero.
ZERO = -(1 << 20)
#: How far above the median the fence of a measure lies, in distances from the lower quartile to the median.
REACH = {"symbol_share": 5.0, "dup_line_share": 5.0, "repeat_share": 5.0, "word_length": 10.0, "shout_share": 5.0}
#: Sampling errors that part a fence from the median, and a document that is rejected from the fence.
ERRORS = 4.0
#: Counted parts and what they are counted in, and how many come at once: repeats come by windows of eight words.
SHARES = {"symbol_share": ("n_symbols", "word_chars", 1), "dup_line_share": ("n_dup_lines", "n_lines", 1), "repeat_share": ("n_repeat_words", "n_words", 8), "word_length": ("word_chars", "n_words", 1), "shout_share": ("n_shout", "n_words", 1)}
#: All documents count as so many in each group's quantiles.
PRIOR_ROWS = 50
#: Fences of at most so many groups (under 100 bytes each) go to every task; beyond, they are joined by a shuffle, each group on ``SALTS`` keys.
MOST_BROADCAST_GROUPS, SALTS = 50_000, 32
BASE_LEAST_WORDS, BASE_MOST_REPEATED = 20, 30


def measured(docs: DataFrame, keep: list[str] | None = None, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """For each row of ``docs``: ``row`` with its columns ``keep``, else all; ``by_<name>`` for each of ``by``; the counts; and for each measure its rate and, as ``<measure>_size``, its size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = text
    for space in SPACE_CHARS:
        solid = F.replace(solid, F.lit(space), F.lit(""))
    groups = {f"by_{c}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by}
    kept = ["row", *groups]
    given = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row"), "text", *[c.alias(name) for name, c in groups.items()])
    lines = given.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    counts = lines.select(
        *kept,
        F.char_length(solid).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[A-Z]{2,}")).cast("long").alias("n_shout"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h1"),
    )
    # windows of 4 words come first: a text without an equal pair of those has no equal pair of 8 words
    by_two = counts.withColumns({"n_words": F.size("h1").cast("long"), "h2": joined_hashes(F.col("h1"), 1)}).drop("h1")
    by_four = by_two.withColumn("h4", joined_hashes(F.col("h2"), 2)).drop("h2")
    eight = F.when(F.size(F.array_distinct("h4")) < F.size("h4"), joined_hashes(F.col("h4"), 4)).otherwise(F.array().cast("array<bigint>"))
    by_eight = by_four.withColumn("h8", eight).drop("h4")
    placed = F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = by_eight.withColumn("pairs", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), placed).otherwise(none)).drop("h8")
    twice = F.filter("pairs", lambda p, k: (p["h"] == F.get("pairs", k - 1)["h"]) | (p["h"] == F.get("pairs", k + 1)["h"]))
    places = pairs.withColumn("places", F.sort_array(F.transform(twice, lambda p: p["i"]))).drop("pairs")
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.lit(8), F.coalesce(F.get("places", k + 1), p + 8) - p).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
    )
    some = F.col("n_words") > 0
    rates = {m: F.when(some, F.col(part) / F.col(whole)) for m, (part, whole, _) in SHARES.items()}
    sizes = {f"{m}_size": F.when(some, F.col(whole) / unit) for m, (_, whole, unit) in SHARES.items()}
    return places.withColumn("n_repeat_words", covered).drop("places").withColumns(rates | sizes)


def base_failed() -> Column:
    """True for a text with too few words or too many of them in repeated windows of eight words."""
    return (F.col("n_words") < BASE_LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_MOST_REPEATED * F.col("n_words"))


def sketches(measures: DataFrame, by: list[str]) -> DataFrame:
    """Quantile sketches: ``by..., measure, bucket, count``. Sketches of parts merge by adding the counts of equal buckets."""
    values = F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).alias("v")) for m in SHARES for c in (m, f"{m}_size")])
    each = measures.filter("n_words > 0").select(*by, F.explode(values).alias("x"))
    bucket = F.when(F.col("x.v") > 0, F.ceil(F.ln("x.v") / float(math.log(GROWTH)))).otherwise(ZERO).cast("int")
    return each.groupBy(*by, F.col("x.m").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("count"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Lower quartile and median of each group and measure, and the rows behind them: ``by..., measure, low, mid, rows``."""
    group = [*by, "measure"]
    so_far = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counted = sketch.withColumns({"upto": F.sum("count").over(so_far), "rows": F.sum("count").over(Window.partitionBy(*group))})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("bucket")))
    value = lambda c: F.when(F.col(c) == ZERO, 0.0).otherwise(F.pow(F.lit(GROWTH), F.col(c)))
    found = counted.groupBy(*group).agg(at(0.25).alias("low"), at(0.5).alias("mid"), F.max("rows").alias("rows"))
    return found.withColumns({"low": value("low"), "mid": value("mid")})


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The upper fence of each group, with a column ``fence_<measure>`` each, from its sketches and those of all groups together."""
    whole = quantiles(sketch.groupBy("measure", "bucket").agg(F.sum("count").alias("count")), []).select("measure", F.col("low").alias("all_low"), F.col("mid").alias("all_mid"))
    both = quantiles(sketch, by).join(F.broadcast(whole), "measure")  # two rows a measure
    pooled = lambda c: (F.col("rows") * F.col(c) + PRIOR_ROWS * F.col(f"all_{c}")) / (F.col("rows") + PRIOR_ROWS)
    of = lambda m, c: F.max(F.when(F.col("measure") == m, pooled(c)))
    wide = both.groupBy(*by).agg(*[of(m, c).alias(f"{c}_{m}") for m in SHARES for c in ("low", "mid")], *[of(f"{m}_size", "mid").alias(f"size_{m}") for m in SHARES])
    low, mid, size = (lambda m, c=c: F.col(f"{c}_{m}") for c in ("low", "mid", "size"))
    least = lambda m: F.pow(F.sqrt(mid(m) * size(m)) + ERRORS / 2, 2) / size(m)
    return wide.select(*by, *[F.greatest(mid(m) + REACH[m] * (mid(m) - low(m)), least(m)).alias(f"fence_{m}") for m in SHARES])


def surely(m: str) -> Column:
    """The rate that a document is above by ``ERRORS`` sampling errors; zero for small counts."""
    return F.pow(F.greatest(F.sqrt(F.col(m) * F.col(f"{m}_size")) - ERRORS / 2, F.lit(0.0)), 2) / F.col(f"{m}_size")


def judged(docs: DataFrame, keep: list[str] | None = None, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """For each row of ``docs``: ``row`` with its columns ``keep``, else all; the counts; ``base_failed`` and ``kept``.

    The measures are computed once and written; the fences, one row a group, come from them and are joined back.
    """
    measures = written(measured(docs, keep, by), "measures")
    keys = [f"by_{c}" for c in by]
    bounds = checkpointed(fences(sketches(measures, keys), keys))
    if bounds.count() <= MOST_BROADCAST_GROUPS:
        joined = measures.join(F.broadcast(bounds), keys, "left")
    else:
        salted = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measures.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(salted, [*keys, "salt"], "left")
    within = F.lit(True)
    for m in SHARES:
        within = within & F.coalesce(surely(m) <= F.col(f"fence_{m}"), F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shout"]
    return joined.select("row", *counts, *SHARES, base_failed().alias("base_failed"), (~base_failed() & within).alias("kept"))


def filtered(docs: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    return judged(docs, by=by).filter("kept").select("row.*")
