"""A state machine over ordered logs, folded chunk by chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The legal transitions (state, command, next state)
MOVES = (("idle", "load", "loading"), ("loading", "ready", "ready"), ("ready", "play", "playing"), ("ready", "seek", "ready"), ("playing", "play", "playing"), ("playing", "pause", "paused"), ("playing", "seek", "playing"), ("playing", "end", "ended"), ("paused", "play", "playing"), ("paused", "pause", "paused"), ("paused", "seek", "paused"), ("ended", "play", "playing"), ("ended", "seek", "ready"))
STATES = tuple(dict.fromkeys(s for a, _, b in MOVES for s in (a, b)))
#: Commands of a log that are folded in one expression.
CHUNK = 1024


def states(log: DataFrame, key: str, order: str, command: str, start: str = "ready") -> DataFrame:
    """(key, order, state, legal): the state after each command of a key's log; an illegal command changes nothing.

    A log is cut into chunks.  A chunk's commands take each state to another, whatever came
    before; these maps, few per log, are chained to the state that each chunk starts in, and
    the chunks are folded from there.
    """
    move = F.create_map(*[F.lit(v) for s, c, t in MOVES for v in (f"{s}|{c}", t)])
    after = lambda state, c: F.try_element_at(move, F.concat_ws("|", state, c))
    numbered = log.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(command).alias("c")).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1)
    parts = numbered.groupBy("k", F.floor(F.col("i") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("o", "c"))).alias("log"))
    ends = F.create_map(*[x for s in STATES for x in (F.lit(s), F.aggregate("log", F.lit(s), lambda a, x: F.coalesce(after(a, x["c"]), a)))])
    chain = parts.select("k", "chunk", ends.alias("ends")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("chunk", F.map_entries("ends").alias("ends")))).alias("all"))

    def follow(acc: Column, x: Column) -> Column:
        to = F.element_at(F.filter(x["ends"], lambda e: e["key"] == acc["s"]), 1)["value"]
        return F.struct(to.alias("s"), F.concat(acc["out"], F.array(F.struct(x["chunk"].alias("chunk"), acc["s"].alias("start")))).alias("out"))

    begin = F.struct(F.lit(start).alias("s"), F.expr("cast(array() as array<struct<chunk:bigint,start:string>>)").alias("out"))
    starts = chain.select("k", F.explode(F.aggregate("all", begin, follow, lambda a: a["out"])).alias("x")).select("k", "x.chunk", "x.start")
    kind = dict(log.dtypes)[order]

    def step(acc: Column, x: Column) -> Column:
        to = after(acc["s"], x["c"])
        state = F.coalesce(to, acc["s"])
        return F.struct(state.alias("s"), F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), state.alias("state"), to.isNotNull().alias("legal")))).alias("out"))

    first = F.struct(F.col("start").alias("s"), F.expr(f"cast(array() as array<struct<o:{kind},state:string,legal:boolean>>)").alias("out"))
    done = parts.join(starts, ["k", "chunk"]).select("k", F.explode(F.aggregate("log", first, step, lambda a: a["out"])).alias("r"))
    return done.select(F.col("k").alias(key), F.col("r.o").alias(order), "r.state", "r.legal")
