"""Best paths through the graphs of all regions at once, held as back-pointers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import checkpoint, written

MAX_PATHS = 128  # fixed value: paths kept for a region


def k_best_paths(edges: DataFrame, ends: DataFrame, keys: Sequence[str], k: int = MAX_PATHS, settle_every: int = 4) -> DataFrame:
    """Best ``k`` paths per region from ``ends`` (keys, source, sink): ``path``, ``score`` and ``rank``.

    Every round extends the arrivals of the round before by one edge. An arrival is a node, its score and a pointer to the
    arrival it came from; it goes on if fewer than ``k`` arrivals at its node, of this round and all before, come first.
    Only new arrivals are ranked, each against its node's ``k`` best scores so far. Score is the sum of log10(edge
    support / total leaving support), which no edge raises, so a walk round a cycle comes after the walk without it and
    the rounds end by themselves. Equal scores go to fewer steps, then to the text of the path, whose order among
    arrivals of one round follows from the order of the round before.

    Text is made at the end only: paths are followed back from the sinks by pointers that double in reach each time.
    """
    keys = list(keys)
    total = edges.groupBy(*keys, "src").agg(F.sum("support").alias("__t"))
    cost = checkpoint(
        edges.join(total, [*keys, "src"]).select(*keys, F.col("src").alias("node"), "dst", F.log10(F.col("support") / F.col("__t")).alias("c"))
    )
    # ``place`` numbers the arrivals of a region and round in the order of their texts.
    texts = Window.partitionBy(*keys).orderBy("__before", F.right("node", F.lit(1)), "node")
    start = ends.select(*keys, F.col("source").alias("node")).distinct().select(
        *keys, "node", F.lit(0.0).alias("score"), F.lit(0).alias("step"), F.lit(None).cast("int").alias("back"),
        F.row_number().over(Window.partitionBy(*keys).orderBy("node")).alias("place"),
    )
    frontier = checkpoint(start)
    rounds = [frontier]
    settled, recent = frontier.select(*keys, "node", F.array("score").alias("scores")), []

    def best() -> DataFrame:
        """The best scores of each node so far: those settled, and the arrivals since."""
        single = settled.select(*keys, "node", F.explode("scores").alias("score"))
        both = reduce(DataFrame.unionByName, [r.select(*keys, "node", "score") for r in recent], single)
        return both.groupBy(*keys, "node").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k).alias("scores"))

    step = 0
    while True:
        step += 1
        grown = frontier.join(cost, [*keys, "node"]).select(
            *keys, F.col("dst").alias("node"), (F.col("score") + F.col("c")).alias("score"), F.lit(step).alias("step"), F.col("place").alias("back"),
        )
        held = grown.join(best() if recent else settled, [*keys, "node"], "left")
        ahead = F.size(F.filter(F.coalesce("scores", F.array().cast("array<double>")), lambda s: s >= F.col("score")))
        rank = F.row_number().over(Window.partitionBy(*keys, "node").orderBy(F.col("score").desc(), "back"))
        kept = held.withColumn("__rank", rank + ahead).where(F.col("__rank") <= k).withColumn("__before", F.col("back"))
        frontier = checkpoint(kept.withColumn("place", F.row_number().over(texts)).select(*keys, "node", "score", "step", "back", "place"))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
        recent.append(frontier)
        if len(recent) == settle_every:
            settled, recent = checkpoint(best()), []
    arrivals = written(reduce(DataFrame.unionByName, rounds), "arrivals")
    goal = ends.select(*keys, F.col("sink").alias("node")).distinct()
    done = arrivals.join(goal, [*keys, "node"], "left_semi")
    first = F.row_number().over(Window.partitionBy(*keys, "node").orderBy(F.col("score").desc(), "step", "place"))
    done = checkpoint(done.withColumn("__n", first).where(F.col("__n") <= k).drop("__n"))
    texts_of = _texts(arrivals, keys, step)
    found = done.join(texts_of, [*keys, "step", "place"]).select(*keys, "path", "score")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "path"))).where(F.col("rank") <= k)


def _texts(arrivals: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """The path of every arrival: text of its last 2^i steps and a pointer past them, until all rest on a source."""
    at = arrivals.select(
        *keys, "step", "place", F.when(F.col("step") == 0, F.col("node")).otherwise(F.right("node", F.lit(1))).alias("path"),
        (F.col("step") - 1).alias("to_step"), F.col("back").alias("to_place"),
    )
    reach = 1
    while reach < steps:
        onto = at.select(*keys, F.col("step").alias("to_step"), F.col("place").alias("to_place"), F.col("path").alias("before"), F.col("to_step").alias("s"), F.col("to_place").alias("p"))
        j = at.join(onto, [*keys, "to_step", "to_place"], "left")
        at = written(j.select(*keys, "step", "place", F.concat(F.coalesce("before", F.lit("")), "path").alias("path"), F.col("s").alias("to_step"), F.col("p").alias("to_place")), "paths")
        reach *= 2
    return at.select(*keys, "step", "place", "path")
