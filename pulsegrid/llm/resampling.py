"""Importance resampling towards a target distribution, over hashed n-grams.

A position table holds one row for each word of each text and, for every order, the bucket of the
n-gram that begins there: posexplode() gives the words, a window's lead() in position order the
words that follow.  Buckets are counted over all documents and over the target; a bucket's gain
is the logarithm of its smoothed odds.  Gains, one row a bucket, are joined to the position table
again, and a document's weight is their mean.  Documents are drawn by weight plus Gumbel noise
that the id determines, which is sampling without replacement.

Ranks come from a histogram of scores: scores are whole numbers in a narrow range, so that the
rows above each score are a running sum over few rows, and only rows of one score are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import discard, materialize, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII other than digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Gains are broadcast, so that their number has a bound.
MAX_BUCKETS = 1 << 20


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and characters beyond ASCII, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def position_table(texts: DataFrame, low: int, high: int, buckets: int) -> DataFrame:
    """(the columns of texts but `text`, row, n_words, bucket): one row for each n-gram of low to high words; one with a null bucket for a text without any.

    texts: `text` and other columns.  `row` tells the rows of texts.
    """
    rest = [c for c in texts.columns if c != "text"]
    base = texts.withColumn("row", F.monotonically_increasing_id()).withColumn("ws", words(F.coalesce("text", F.lit("")))).withColumn("n_words", F.size("ws"))
    at = base.select(*rest, "row", "n_words", F.posexplode_outer("ws").alias("pos", "word"))
    of = lambda gram: F.pmod(F.crc32(gram), F.lit(buckets)).cast("int")
    if high == 1:  # nothing follows a word
        return at.select(*rest, "row", "n_words", of(F.col("word")).alias("bucket"))
    w = Window.partitionBy("row").orderBy("pos")
    gram, grams = F.col("word"), []
    for order in range(1, high + 1):
        if order > 1:
            gram = F.concat(gram, F.lit(" "), F.lead("word", order - 1).over(w))  # null beyond the end
        if order >= low:
            grams.append(gram.alias(f"g{order}"))
    wide = at.select(*rest, "row", "n_words", "pos", *grams)
    each = F.filter(F.array(*[of(F.col(f"g{order}")) for order in range(low, high + 1)]), lambda b: b.isNotNull())
    # a text's first word keeps its row where the text is too short for any n-gram
    some = F.when((F.size(each) == 0) & (F.coalesce("pos", F.lit(0)) == 0), F.array(F.lit(None).cast("int"))).otherwise(each)
    return wide.select(*rest, "row", "n_words", F.explode(some).alias("bucket"))


def gains(counts: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets: floor(1000 ln((t+1)(S+b) / ((s+1)(T+b)))); s and t of the bucket are the n of counts and target, S and T their sums."""
    all_s, all_t = (float(df.agg(F.sum("n")).first()[0] or 0) for df in (counts, target))
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    return both.select("bucket", F.floor(1000 * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).alias("gain"))


def _scored(docs: DataFrame, target: DataFrame, orders: tuple[int, int], buckets: int, share: tuple[int, int], least_words: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    low, high = orders
    if not (1 <= low <= high and 0 < buckets <= MAX_BUCKETS):
        raise ValueError("orders rise from 1, and there are 1 to 2**20 buckets")
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"), text.alias("text"))
    places = materialize(position_table(base, low, high, buckets), "positions")
    count = lambda df: df.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    seen = materialize(count(places), "buckets")
    aim = materialize(count(position_table(target.select(text.alias("text")), low, high, buckets)), "target")
    gain = materialize(gains(seen, aim, buckets), "gains")
    # a text's rows stand together: partial sums leave few rows a text for the shuffle
    of = places.join(F.broadcast(gain), "bucket", "left").groupBy("row").agg(F.first("id").alias("id"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("n_words").alias("n_words"), F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    of = of.withColumn("weight", F.when(F.col("n") == 0, F.lit(0)).otherwise(F.expr("(sum - pmod(sum, n)) div n")).cast("long"))
    of = of.select("id", "a", "b", F.col("n").alias("n_features"), "weight", (F.col("weight") + noise).cast("long").alias("score"), ((F.col("n_words") >= least_words) & F.col("id").isNotNull()).alias("fit"))
    of = materialize(of, "scores")
    discard(places, seen, aim, gain)

    # the running sum goes over distinct scores: whole numbers of some 1,000 times a logarithm, whatever the number of rows
    by_score = of.where("fit").groupBy("score").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = share[0] * of.where("fit").count() // share[1]
    offsets = materialize(by_score.select("score", above.cast("long").alias("above")).where(F.col("above") < take), "offsets")
    near = of.join(small_side(offsets), "score", "left")
    order = Window.partitionBy("score").orderBy("id", "n_features", "a", "b")
    ranked = near.where("fit and above is not null").withColumn("rank", F.col("above") + F.row_number().over(order))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    columns = ["id", "a", "b", "n_features", "weight", "score"]
    others = near.where("not fit or above is null").select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, F.col("rank").cast("long")).unionByName(others)


def resample(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = (1, 2), buckets: int = 10_000, share: tuple[int, int] = (10, 100), least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per input row.

    Features are all runs of orders[0] to orders[1] consecutive words, joined by one space,
    repeats counted; a feature's bucket is its crc32 modulo `buckets`.  weight is the floored
    mean of the gains of a document's features, 0 without any; score adds Gumbel noise from
    sha256 of the seed and the id.  Of the N rows with at least `least_words` words, the
    share[0] * N // share[1] of highest score are drawn: rank 1, 2, 3...; ties go to the smaller
    id.  Rows that aren't drawn have a null rank.

    A null text has no words.  A row with a null id is counted in the corpus but has neither
    score nor rank and isn't one of the N.  Rows that share an id are documents of their own
    with equal noise.  Other columns are ignored.  Empty tables are allowed; an empty target
    gives the gains of counts of 0.
    """
    return _scored(docs, target, orders, buckets, share, least_words, seed, id_col, text_col).drop("a", "b").withColumnRenamed("id", "doc_id")


def draw(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = (1, 2), buckets: int = 10_000, share: tuple[int, int] = (10, 100), least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that resample() draws, all columns.  Of rows equal in id and text all stay if one is drawn."""
    drawn = _scored(docs, target, orders, buckets, share, least_words, seed, id_col, text_col).where("rank is not null")
    drawn = materialize(drawn.select(*[F.col(c).alias(f"_{c}") for c in ("id", "a", "b")]).distinct(), "drawn")
    text = F.col(text_col).cast("string")
    keyed = docs.withColumn("_id", F.col(id_col).cast("long")).withColumn("_a", F.xxhash64(text)).withColumn("_b", F.xxhash64(F.lit("text"), text))
    return keyed.join(small_side(drawn), ["_id", "_a", "_b"], "left_semi").select(*docs.columns)
