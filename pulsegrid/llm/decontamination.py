"""Benchmark decontamination by size-partitioned MinHash containment search, DataFrame functions only.

Which documents contain a benchmark item, however long the document?  An item's shingle hashes
are in a random order; its sketch is the k smallest of them.  Items are partitioned by size
(powers of two of their number of shingles), and each partition has the sketch length that its
largest size u needs: k = u - ceil(t*u) + 1.  A document that holds at least ceil(t*n) of an
item's n shingles misses at most n - ceil(t*n) < k, so it holds one of the k: probing documents
for sketch hashes loses nothing.  Documents with too few words for an item are passed over.
Documents aren't sketched: each shingle of theirs is looked up among the items' sketches, so that
an item is found inside a document of any length.  Candidates are verified by exact containment,
counted over the candidates' texts only and with the shingles' words, not their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import BROADCAST_ROWS, materialize, small_side

#: Distinct probe hashes up to which they are broadcast, alone, to sift the documents' shingles before these are shuffled.
SIFT_ROWS = 4_000_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def shingles_of(hashes: Column, width: int) -> Column:
    """Hashes of all runs of `width` of the word hashes; empty where there are fewer."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(F.lit(width), *[F.get(hashes, i + j) for j in range(width)]))
    return F.when(F.size(hashes) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def texts_of(words: Column, width: int) -> Column:
    """All runs of `width` words, joined by blanks; empty where there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, F.lit(width)), " "))
    return F.when(F.size(words) >= width, runs).otherwise(F.array().cast("array<string>"))


def _of_width(make, words: Column, k: int) -> Column:
    """make(words, k), or of all words where there are fewer than k."""
    out = make(words, k)
    for w in range(1, k):
        out = F.when(F.size(words) == w, make(words, w)).otherwise(out)
    return out


def _sketches(benchmark: DataFrame, k: int, percent: int, item_col: str, text_col: str) -> DataFrame:
    """(item_id, width, n, least, shingles, sketch) per item that has words."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null")
    items = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    shingles, hashes = F.array_distinct(_of_width(texts_of, F.col("words"), k)), F.array_sort(F.array_distinct(_of_width(shingles_of, F.col("h"), k)))
    items = items.select("item_id", F.least(F.lit(k), F.size("h")).alias("width"), shingles.alias("shingles"), hashes.alias("hashes"))
    items = items.withColumn("n", F.size("shingles")).withColumn("least", F.ceil(F.col("n") * percent / 100).cast("int"))
    largest = F.least(F.lit(1 << 30), F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1).cast("long")
    length = (largest - F.ceil(largest * percent / 100) + 1).cast("int")
    return items.withColumn("partition", F.floor(F.log2("n")).cast("int")).withColumn("sketch", F.slice("hashes", 1, F.least(length, F.col("n")))).drop("hashes")


def find_contained(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, doc_id, n_item, n_shared, containment): the pairs with 100 * n_shared >= percent * n_item.

    An item of fewer than k words is one shingle of all its words.  Items or documents without
    words, and null texts, are in no pair; rows with a null id take no part.  Rows that share
    an id count as one document (or each as an item of that id, of which the largest overlap
    is returned).  Other columns are ignored; texts are never cut.
    """
    items = materialize(_sketches(benchmark, k, percent, item_col, item_text_col).withColumn("row", F.monotonically_increasing_id()), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most k values
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    if not widths:
        return items.select("item_id", F.lit(None).cast(base.schema["doc_id"].dataType).alias("doc_id"), F.col("n").alias("n_item"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment")).limit(0)

    def shingled(rows: DataFrame) -> DataFrame:
        hashed = rows.select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
        parts = [shingles_of(F.col("h"), w) for w in widths]
        all_of = parts[0] if len(parts) == 1 else F.concat(*parts)
        return hashed.select("doc_id", F.size("h").alias("n_words"), F.explode(all_of).alias("hash"))

    probes = materialize(items.select("item_id", "width", "least", F.explode("sketch").alias("hash")), "probes")
    fits = F.col("n_words") - F.col("width") + 1 >= F.col("least")
    hashed = shingled(base)
    if probes.count() > BROADCAST_ROWS:
        hashed = hashed.join(small_side(probes.select("hash").distinct(), SIFT_ROWS), "hash", "left_semi")
    candidates = hashed.join(small_side(probes), "hash").where(fits).select("item_id", "doc_id").distinct()
    candidates = materialize(candidates, "candidates")

    ids = materialize(candidates.select("doc_id").distinct(), "ids")
    whole = materialize(items.select("item_id", F.col("n").alias("n_item"), "row", F.explode("shingles").alias("shingle")), "shingles")
    suspects = base.join(small_side(ids), "doc_id", "left_semi").select("doc_id", words_of(F.col("text")).alias("words"))
    suspects = suspects.select("doc_id", F.explode(F.concat(*[texts_of(F.col("words"), w) for w in widths])).alias("shingle"))
    shared = suspects.join(small_side(whole), "shingle").join(small_side(candidates), ["item_id", "doc_id"], "left_semi").distinct()
    counted = shared.groupBy("item_id", "doc_id", "row", "n_item").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = counted.groupBy("item_id", "doc_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("b"))
    return best.select("item_id", "doc_id", F.col("b.n_item").alias("n_item"), F.col("b.n_shared").alias("n_shared"), F.round(F.col("b.n_shared") / F.col("b.n_item"), 6).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item; decided by the texts, so ids may be null or shared.  Null texts stay."""
    key = F.struct(F.xxhash64(F.col(text_col).cast("string")).alias("a"), F.xxhash64(F.lit("text"), F.col(text_col).cast("string")).alias("b"))
    keyed = docs.withColumn("_key", F.when(F.col(text_col).isNotNull(), key))
    found = materialize(find_contained(keyed, benchmark, id_col="_key", text_col=text_col, **how).select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return keyed.join(small_side(found), "_key", "left_anti").select(*docs.columns)
