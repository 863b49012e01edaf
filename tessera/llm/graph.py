"""Connected components of a distributed table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X

#: A node with more than one in so many links of the step before is a hub; steps never add links, so there are no more hubs than this.
HUBS = 64
#: Steps after which the shuffles of earlier ones are released.
RELEASE = 3
#: Links that one task contracts to stars by itself; what its stars leave open is settled by the steps.
LOCAL = 1 << 20


def contracted(batches):
    """The links of a partition to stars: each node under the smallest one that these links reach from it."""
    hi, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        hi.append(batch.column("hi").to_numpy())
        lo.append(batch.column("lo").to_numpy())
    hi = np.concatenate(hi)
    ids, at = np.unique(np.r_[hi, np.concatenate(lo)], return_inverse=True)
    x, y, label = at[: len(hi)], at[len(hi) :], np.arange(len(ids))
    while len(x):  # roots are hung under their smallest neighbours, so no more than half of them stay
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((up := label[label]) != label).any():
            label = up
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    at = np.flatnonzero(label != np.arange(len(ids)))
    for i in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_pydict({"hi": ids[at[i : i + 50_000]], "lo": ids[label[at[i : i + 50_000]]]})


def starred(e: DataFrame) -> DataFrame:
    """(doc_id, component_id) of stars: their members and centres."""
    centres = e.select(F.col("lo").alias("doc_id"), F.col("lo").alias("component_id")).distinct()
    return e.select(F.col("hi").alias("doc_id"), F.col("lo").alias("component_id")).unionByName(centres)


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(doc_id, component_id) of every linked document; component_id is its smallest member.

    Tasks of at most about LOCAL links contract theirs to stars first. If there is more than one such task, steps follow:
    alternating large-star and small-star steps: each node is hung under the smallest neighbour until
    every component is one star. Minima are combined before the shuffle. They are joined back by node, but
    for hubs, whose links alone could fill a task: a hub has more than 1 / HUBS of all links, so there
    are at most HUBS of them, and their minima are broadcast. Each step is checkpointed to the shared folder.
    Null ids, loops and repeated links change nothing.
    """
    X.ensure_checkpoint_dir(links.sparkSession)
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct().checkpoint()
    tasks = max(1, -(-e.count() // LOCAL))
    e = e.select(F.col("hi").cast("long"), F.col("lo").cast("long")).coalesce(tasks).mapInArrow(contracted, "hi long, lo long").checkpoint()
    if tasks == 1:
        return starred(e)
    before, hub_links = None, 0
    for step in range(most):
        if step % RELEASE == 0:
            X.release(links.sparkSession)
        by = e.groupBy("lo").agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"))
        n, h, hubs = by.agg(F.sum("n"), F.sum("h"), F.collect_list(F.when(F.col("n") > hub_links, F.col("lo"))) if hub_links else F.array()).first()
        if (n, h) == before or not n:
            return starred(e)
        before, hub_links = (n, h), max(n // HUBS, 1)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        is_hub = F.col("u").isin(hubs)
        up = both.where("v > u")
        large = up.where(~is_hub).join(least, "u").unionByName(up.where(is_hub).join(F.broadcast(least.where(is_hub)), "u"))
        large = large.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = small.unionByName(down.select("hi", F.col("m").alias("lo"))).distinct().checkpoint()
    raise RuntimeError("components did not settle")
