"""Closures, fixpoints, prefix, interval and as-of joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df without lineage, kept in the shared checkpoint folder.

    The planner forgets the size it had guessed from the bytes of compressed files: by that guess, tables far larger than the
    broadcast threshold went through the driver. Joins over the copy are planned by measured bytes instead.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file:///tmp/checkpoints/tessera"  # one machine, as in tests
        sc.setCheckpointDir(f"{base}/graph-{uuid.uuid4().hex}")
    kept = df.checkpoint()
    spark, jvm = df.sparkSession, sc._jvm
    plan, none = kept._jdf.queryExecution().analyzed(), jvm.scala.Option.empty()
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def dealt(df: DataFrame, *by: str, of: DataFrame | None = None, rows: int = 500_000) -> DataFrame:
    """df dealt by `by` to partitions of about `rows` rows of `of` (itself if not given), which are not merged for compressing well."""
    n = max(1, -(-(df if of is None else of).count() // rows))
    return df.repartition(n, *by)


def closure(seeds: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst", node: str = "node", root: str = "root", rounds: int = 1000) -> DataFrame:
    """(root, node) reachable from each seed, seeds included. Frontier by frontier, so cycles end."""
    front = cut(seeds.select(F.col(root), F.col(node)).distinct())
    seen = front
    e = cut(edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct())
    for _ in range(rounds):
        step = front.join(e, F.col(node) == F.col("_s")).select(root, F.col("_d").alias(node)).distinct()
        front = cut(step.join(seen, [root, node], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)  # a union of written deltas: what is known is not written again
    raise RuntimeError("closure did not settle")


def cascade(nodes: DataFrame, edges: DataFrame, removed: DataFrame, veto: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 1000) -> DataFrame:
    """(node, round): nodes that lose all users once `removed` and their successors are deleted.

    nodes(node), edges(src, dst), removed(node). A node falls in the first round in which it had a user
    and every user is removed. veto(newly) returns the nodes that must stay; a vetoed node stays for good.
    """
    gone = cut(removed.select("node", F.lit(0).alias("round")).distinct())
    out = cut(edges.select("src", "dst"))
    left = cut(out.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).join(nodes.select("node").distinct(), "node", "left_semi"))
    new, kept, all_gone = gone.select("node"), None, gone
    for i in range(1, rounds):
        # only the out-edges of what fell last are taken from the counts of remaining users
        less = new.withColumnRenamed("node", "src").join(out, "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("k"))
        left = cut(left.join(less, "node", "left").select("node", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")))
        new = left.where("n = 0").select("node").join(all_gone.select("node"), "node", "left_anti")
        if kept is not None:
            new = new.join(kept, "node", "left_anti")
        new = cut(new)
        if veto is not None:
            held = cut(veto(new).select("node").distinct())
            kept = held if kept is None else kept.unionByName(held).distinct()
            new = cut(new.join(held, "node", "left_anti"))
        if new.isEmpty():
            return all_gone
        all_gone = all_gone.unionByName(cut(new.withColumn("round", F.lit(i))))
    raise RuntimeError("cascade did not settle")


def shrink(universe: DataFrame, edges: DataFrame, keep: Callable[[DataFrame, DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """Largest subset that keep(members, edges) maps to itself: members it drops leave, until none does."""
    members = cut(universe.select("node").distinct())
    n = members.count()
    for _ in range(rounds):
        members = cut(keep(members, edges).select("node").distinct())
        m = members.count()
        if m == n:
            return members
        n = m
    raise RuntimeError("shrink did not settle")


def closed_scaffold(universe: DataFrame, edges: DataFrame) -> DataFrame:
    """Members whose users are all members: anything a survivor uses is demoted, again and again."""

    def keep(members: DataFrame, e: DataFrame) -> DataFrame:
        outside = e.join(members.select(F.col("node").alias("src")), "src", "left_anti").select(F.col("dst").alias("node"))
        return members.join(outside, "node", "left_anti")

    return shrink(universe, edges, keep)


def nearest_prefix(rows: DataFrame, path: str, table: DataFrame, key: str, out: str) -> DataFrame:
    """rows with `out`: the longest table.key that is rows.path or a segment prefix of it. Equi joins only."""
    at = rows.withColumn("_id", F.monotonically_increasing_id())
    at = cut(at)
    parts = F.split(path, "::")
    pre = at.select("_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))).alias("_n", "_k"))
    best = pre.join(table.select(F.col(key).alias("_k")).distinct(), "_k").groupBy("_id").agg(F.max_by("_k", "_n").alias(out))
    return at.join(best, "_id", "left").drop("_id")


def innermost(points: DataFrame, spans: DataFrame, by: str, at: str, lo: str = "lo", hi: str = "hi", width: int = 4096) -> DataFrame:
    """points with the shortest span of the same `by` with lo <= at < hi (inner join).

    Spans are dealt to cells of `width`; a point looks only into its own cell, so a file with very many
    spans is no all-pairs join.
    """
    p = cut(points.withColumn("_p", F.monotonically_increasing_id()))
    cells = spans.where(F.col(hi) > F.col(lo)).withColumn("_c", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    hit = p.withColumn("_c", F.floor(F.col(at) / width)).join(cells, [by, "_c"]).where((F.col(lo) <= F.col(at)) & (F.col(at) < F.col(hi)))
    names = [c for c in spans.columns if c not in (by,)]
    best = hit.groupBy("_p").agg(F.min_by(F.struct(*names), F.struct(F.col(hi) - F.col(lo), F.col(lo))).alias("_s"))
    return p.join(best, "_p").select(*points.columns, "_s.*")


def innermost_by_start(points: DataFrame, spans: DataFrame, by: str, line: str, col: str, width: int = 256) -> DataFrame:
    """points with the span of the same `by` that starts last among those holding (line, col); spans(line_lo, col_lo, line_hi, col_hi), ends included."""
    p = cut(points.withColumn("_p", F.monotonically_increasing_id()))
    cells = spans.withColumn("_c", F.explode(F.sequence(F.floor(F.col("line_lo") / width), F.floor(F.col("line_hi") / width))))
    at = F.struct(F.col(line).alias("l"), F.col(col).alias("c"))
    lo, hi = (F.struct(F.col(f"line_{x}").alias("l"), F.col(f"col_{x}").alias("c")) for x in ("lo", "hi"))
    hit = p.withColumn("_c", F.floor(F.col(line) / width)).join(cells, [by, "_c"]).where((lo <= at) & (at <= hi))
    names = [c for c in spans.columns if c != by]
    best = hit.groupBy("_p").agg(F.max_by(F.struct(*names), F.struct("line_lo", "col_lo", (-F.col("line_hi")).alias("h"))).alias("_s"))
    return p.join(best, "_p").select(*points.columns, "_s.*")


def latest_before(left: DataFrame, right: DataFrame, by: list[str], at: str, value: Column, out: str) -> DataFrame:
    """As-of join: for each left row the value of the last right row with a strictly smaller `at`.

    One sort of both sides by key and time, then a running last; no pair of rows is formed.
    """
    from pyspark.sql.window import Window

    names = [c for c in left.columns if c not in by and c != at]
    a = left.select(*by, at, F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(value).schema[0].dataType).alias("_v"))
    b = right.select(*by, at, F.lit(2).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), value.alias("_v"))
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(out, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*by, at, "_row.*", out)


def coalesce_ranges(rows: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", merge: dict[str, Column] | None = None) -> DataFrame:
    """Union of overlapping or touching ranges (gaps and islands); `merge` gives aggregates of what else ranges carry."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    head = F.when(before.isNull() | (F.col(lo) > before), 1).otherwise(0)
    isle = rows.withColumn("_h", head).withColumn("_i", F.sum("_h").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isle.groupBy(*by, "_i").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n_ranges"), *[c.alias(k) for k, c in (merge or {}).items()]).drop("_i")
