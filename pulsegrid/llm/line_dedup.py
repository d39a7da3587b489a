"""Line deduplication over levelled sorted runs of line hashes.

What is known of lines is kept in runs: tables of (key, n, top), one row a key, bucketed and
sorted by key, where key is the digest of a line, n the number of documents that hold it and top
the largest id of those.  A batch of documents is reduced to such rows, merge-anti-joined with
every run, and what is left becomes a run of its own: a key that some run has settled (enough
documents, none of the batch's with a larger id) adds nothing.  As soon as a level has FANOUT
runs, they are merged into one of the next level.  Runs are co-located by key: neither the
anti-joins nor the merges move their rows, and a batch reads a logarithmic number of runs.

Everything is DataFrame operations; nothing is collected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.shared import BROADCAST_ROWS, delete_path, discard, materialize, scratch_root, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Batches that a whole table is taken in.
BATCHES = 4


class LineRuns:
    """The levelled runs of one store; `enough` is the number of documents from which a key is settled.

    add() takes batches in any order; batches of falling ids settle most keys early and leave
    the smallest runs.  All rows of one id have to come in one batch.
    """

    def __init__(self, spark: SparkSession, enough: int, buckets: int | None = None):
        self.spark, self.enough = spark, enough
        self.buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
        self.levels: list[str | None] = []
        self.root = f"{scratch_root(spark).rstrip('/')}/pulsegrid/runs-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame) -> str:
        name = f"pulsegrid_run_{uuid.uuid4().hex}"
        rows.select("key", "n", "top").write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, f"{self.root}/{name}")

    def _merged(self, one: str, other: str) -> str:
        """The run that replaces two: a merge join of sorted buckets."""
        a, b = (self.spark.table(name).select("key", F.col("n").alias(f"n{i}"), F.col("top").alias(f"top{i}")) for i, name in enumerate((one, other)))
        n = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
        name = self._write(a.hint("merge").join(b, "key", "full_outer").select("key", n.alias("n"), F.greatest("top0", "top1").alias("top")))
        self._drop([one, other])
        return name

    def names(self) -> list[str]:
        return [name for name in self.levels if name]

    def add(self, lines: DataFrame) -> None:
        """lines: (key, id), each key once for a document."""
        new = lines.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
        for name in self.names():
            run = self.spark.table(name).where(F.col("n") >= self.enough).alias("run").hint("merge")
            new = new.alias("new").join(run, (F.col("new.key") == F.col("run.key")) & (F.col("run.top") >= F.col("new.top")), "left_anti")
        name = self._write(new)
        for level, old in enumerate(self.levels):
            if old is None:
                self.levels[level] = name
                return
            name, self.levels[level] = self._merged(old, name), None
        self.levels.append(name)

    def repeated(self) -> DataFrame:
        """(key, n, top) of the keys that at least `enough` documents hold; n is a lower bound of their number, top is exact.  All runs are merged into one before."""
        names = self.names()
        if not names:
            return self.spark.createDataFrame([], "key binary, n long, top long")
        while len(names) > 1:
            names = [self._merged(names[0], names[1]), *names[2:]]
            self.levels = list(names)
        return self.spark.table(names[0]).where(F.col("n") >= self.enough)

    def close(self) -> None:
        """Deletes all runs."""
        self._drop(self.names())
        self.levels = []
        delete_path(self.spark, self.root)


def line_keys(text: Column, least: int) -> Column:
    """One entry a line: the digest of the line, stripped and with A-Z in lower case, or null if that has fewer than `least` code points.

    Digests are hexadecimal here, as array_distinct() takes quadratic time for binary values.
    """

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(BLANKS))
        return F.when(F.length(bare) >= least, F.md5(F.translate(bare, UPPER, LOWER)))

    return F.transform(F.split(text, "\n"), key)


def drop_repeated_lines(docs: DataFrame, enough: int = 3, least: int = 20, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each row's text without the lines that repeat elsewhere.

    A line's key is the line stripped of ASCII blanks at both ends, A-Z in lower case.  Keys of
    at least `least` code points that at least `enough` documents hold lose all their lines
    except in the document of the largest id; the others stay, joined by line feeds.

    A null or empty text is one empty line.  Documents are told by their ids: rows that share
    an id count once for a key and keep or lose a line alike.  A row with a null id isn't
    counted and keeps all its lines.  Repeated rows give repeated result rows.  Other columns
    are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("at", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), "text").alias("b")))
    lines = base.where(F.col("id").isNotNull()).select("id", "at", line_keys(F.col("text"), least).alias("keys"))
    lines = materialize(lines.where(F.exists("keys", lambda k: k.isNotNull())), "lines")
    again = materialize(lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    shared = not again.isEmpty()

    edges = sorted(set(lines.approxQuantile("id", [b / batches for b in range(1, batches)], 0.001))) if batches > 1 else []
    bounds = [None, *[int(e) for e in edges], None]
    runs = LineRuns(spark, enough)
    for low, high in reversed(list(zip(bounds[:-1], bounds[1:], strict=True))):
        part = lines
        if low is not None:
            part = part.where(F.col("id") > low)
        if high is not None:
            part = part.where(F.col("id") <= high)
        if shared:
            twice = small_side(again)
            one = part.join(twice, "id", "left_anti").select("id", F.explode(F.array_distinct("keys")).alias("key"))
            part = one.unionByName(part.join(twice, "id", "left_semi").select("id", F.explode("keys").alias("key")).distinct())
        else:
            part = part.select("id", F.explode(F.array_distinct("keys")).alias("key"))
        runs.add(part.where(F.col("key").isNotNull()).select("id", F.unhex("key").alias("key")))
    repeated = materialize(runs.repeated().select("key", "top"), "repeated")
    runs.close()

    held = lines.select("id", "at", F.posexplode("keys").alias("pos", "key")).where(F.col("key").isNotNull()).withColumn("key", F.unhex("key"))
    gone = held.join(small_side(repeated), "key").where("id != top")
    gone = gone.groupBy("id", "at").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    gone = materialize(gone, "gone")
    discard(lines, again, repeated)
    places = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    side = F.broadcast(gone) if places <= BROADCAST_ROWS else gone
    split = base.join(side, ["id", "at"], "left").withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    # the stretches between the lines that go
    start = lambda i: F.when(i == 0, 0).otherwise(F.element_at("gone", i) + 1)
    end = lambda i: F.when(i == F.size("gone"), F.size("lines")).otherwise(F.element_at("gone", i + 1))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.slice("lines", start(i) + 1, end(i) - start(i))))
    n_all = F.coalesce(F.size("lines"), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return split.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("gone").isNotNull(), F.size("lines")).otherwise(n_all).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_dropped"),
    )
