"""Importance resampling towards a target distribution, with features counted once per distinct line.

Features are the runs of one and two consecutive words of a text; each falls into one of ``BUCKETS``
buckets by the unsigned CRC-32 of its UTF-8 bytes. A bucket's gain is the log ratio of its smoothed share
in the target (``benchmark``) to its share in the corpus (``documents``); a document's weight is the
floored mean gain of its features, and a Gumbel key drawn from a hash of its id makes a sample without
replacement of the documents with the highest weight plus key.

Segment deduplication: texts are cut at newlines, which no word holds. The words, features and bucket
counts of each distinct line are computed once and multiplied by its number of occurrences; only the two-word
runs that cross a line break (last word of one line with words, first word of the next) are added per
document. Lines meet by a 128-bit hash of their text; a line held by a third of all rows is split over tasks.

Defined cases: a null text has no words; empty and very long texts are cut into lines like any other;
repeated rows are scored apart, each as a document; a null doc_id gets weight and n_features but no score
and is never drawn, nor counted in N; ties of score go to the smaller doc_id, then to an arbitrary but
fixed row. Only doc_id and text are read, so other columns, whatever their names, are not in the way.
The ranking sorts by score through a table of distinct scores: scores are integers within about
±100,000 whatever the size of the input (gains are bounded by 1000 times the log of the counts), so that
table stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.session import spread_join, written

# Fixed values of the contract: the word pattern, buckets, smoothing, key prefix, share drawn.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
SMOOTHING = 10_000.0
KEY_PREFIX = "7:"
SHARE_PERCENT = 25
MIN_WORDS = 20


def words(text: F.Column) -> F.Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def buckets(found: F.Column) -> F.Column:
    """Buckets of the one- and two-word runs of an array of words."""
    n = F.size(found)
    pairs = F.zip_with(F.slice(found, 1, F.greatest(n - 1, F.lit(0))), F.slice(found, 2, F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(F.concat(found, pairs), bucket)


def bucket(feature: F.Column) -> F.Column:
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("int")


def _line_stats(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences (_row, pos, k1, k2) of lines, and per distinct line its count, words and feature buckets."""
    lines = rows.select("_row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("_row", "pos", F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(7)).alias("k2"), "line")
    distinct = keyed.groupBy("k1", "k2").agg(F.count("*").alias("occ"), F.first("line").alias("line"))
    w = words(F.col("line"))
    stats = distinct.select("k1", "k2", "occ", w.alias("w")).select(
        "k1", "k2", "occ", F.size("w").alias("n_words"), F.get("w", 0).alias("first"),
        F.get("w", F.size("w") - 1).alias("last"), buckets(F.col("w")).alias("feats"))
    stats = written(stats, "resample-distinct")
    return keyed.drop("line"), stats


def _crossings(occurrences: DataFrame) -> DataFrame:
    """(_row, b) of each two-word run across a line break."""
    with_words = occurrences.where("n_words > 0")
    before = F.lag("last").over(Window.partitionBy("_row").orderBy("pos"))
    return with_words.select("_row", bucket(F.concat_ws(" ", before, F.col("first"))).alias("b"),
                             before.isNotNull().alias("crossing")).where("crossing").drop("crossing")


def _counts(features: DataFrame) -> DataFrame:
    """(b, c) of (b, c) rows, summed."""
    return features.groupBy("b").agg(F.sum("c").alias("c"))


def gains(documents_counts: DataFrame, target_counts: DataFrame) -> DataFrame:
    """(b, gain) for all buckets, from (b, c) counts of the corpus and of the target."""
    every = documents_counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    s = documents_counts.withColumnRenamed("c", "s")
    t = target_counts.withColumnRenamed("c", "t")
    joined = every.join(s, "b", "left").join(t, "b", "left").fillna(0, ["s", "t"])
    total = Window.partitionBy()
    big_s, big_t = F.sum("s").over(total), F.sum("t").over(total)  # over BUCKETS rows
    ratio = (F.col("t") + 1) * (big_s + SMOOTHING) / ((F.col("s") + 1) * (big_t + SMOOTHING))
    return joined.select("b", F.floor(F.lit(1000.0) * F.ln(ratio.cast("double"))).alias("gain"))


def weights(documents: DataFrame, target: DataFrame) -> DataFrame:
    """_row, doc_id, n_words, n_features and weight of every row of ``documents``."""
    # Ids from the position in the scan, which is the same whenever the scan is repeated.
    rows = documents.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    keyed, stats = _line_stats(rows)
    occurrences = written(spread_join(keyed, stats.select("k1", "k2", "occ", "n_words", "first", "last"),
                                      ["k1", "k2"], "inner", "occ", ["_row", "pos"]), "resample-occurrences")
    crossings = written(_crossings(occurrences), "resample-crossings")
    corpus = _counts(stats.select(F.explode("feats").alias("b"), F.col("occ").alias("c")).unionByName(
        crossings.select("b", F.lit(1).cast("long").alias("c"))))
    target_counts = _counts(target.select(F.explode(buckets(words(F.col("text")))).alias("b"), F.lit(1).cast("long").alias("c")))
    gain = F.broadcast(written(gains(corpus, target_counts), "resample-gains"))  # BUCKETS rows
    per_line = (stats.select("k1", "k2", "occ", F.explode("feats").alias("b")).join(gain, "b")
                .groupBy("k1", "k2").agg(F.first("occ").alias("occ"), F.sum("gain").alias("g"), F.count("*").alias("nf")))
    lines = spread_join(occurrences.select("_row", "pos", "k1", "k2", "n_words"), per_line, ["k1", "k2"], "left", "occ",
                        ["_row", "pos"])
    by_lines = lines.groupBy("_row").agg(F.sum("n_words").alias("n_words"), F.sum(F.coalesce("g", F.lit(0))).alias("g"),
                                         F.sum(F.coalesce("nf", F.lit(0))).alias("nf"))
    by_crossings = crossings.join(gain, "b").groupBy("_row").agg(F.sum("gain").alias("cg"), F.count("*").alias("cn"))
    summed = by_lines.join(by_crossings, "_row", "left")
    n_features = (F.col("nf") + F.coalesce("cn", F.lit(0))).cast("long")
    total = F.col("g") + F.coalesce("cg", F.lit(0))
    weight = F.when(n_features > 0, F.floor(total.cast("double") / n_features)).otherwise(0).cast("long")
    return rows.select("_row", "doc_id").join(summed, "_row", "left").select(
        "_row", "doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(n_features, F.lit(0)).cast("long").alias("n_features"), F.coalesce(weight, F.lit(0)).cast("long").alias("weight"))


def gumbel(doc_id: F.Column) -> F.Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of sha256('7:<doc_id>')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(KEY_PREFIX), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(documents: DataFrame, target: DataFrame, percent: int = SHARE_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``documents``; rank is null where not drawn.

    ``percent`` of the N rows with a doc_id and at least ``min_words`` words are drawn, rounded down.
    """
    scored = written(weights(documents, target).withColumn(
        "score", F.when(F.col("doc_id").isNotNull(), F.col("weight") + gumbel(F.col("doc_id"))).cast("long"))
        .withColumn("eligible", F.col("score").isNotNull() & (F.col("n_words") >= min_words)), "resample-scored")
    eligible = scored.where("eligible")
    by_score = eligible.groupBy("score").agg(F.count("*").alias("n"))
    higher = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    offsets = by_score.select("score", higher.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    within = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "_row"))
    ranked = eligible.join(offsets, "score").select("_row", (F.col("before") + within).alias("place"), "total")
    drawn = ranked.where(F.col("place") <= F.floor(F.col("total") * percent / 100)).select("_row", "place")
    return scored.join(drawn, "_row", "left").select(
        "doc_id", "n_features", "weight", "score", F.col("place").cast("long").alias("rank"))
