"""Test scaffolding: test items that only serve targets about to be deleted.

links(src, dst): distinct uses between identities, imports, trait-scope facts and synthetic sources left out;
items(path): identities that only test units define; targets(path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import closure, cut
from .model import no


def under(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """(path, root): each path with the roots that are it or an ancestor."""
    parts = F.split(path, "::")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))
    return paths.select(path, F.explode(up).alias("root")).distinct().join(roots.select(F.col("path").alias("root")).distinct(), "root")


def referrers(links: DataFrame, items: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, path): test items with a use of a target or of something under it."""
    hit = under(links.select("dst").distinct(), targets, "dst")
    return links.join(hit, "dst").join(items.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("root").alias("target"), F.col("src").alias("path")).distinct()


def referrer_closure(links: DataFrame, items: DataFrame, targets: DataFrame, removed: DataFrame) -> DataFrame:
    """(path): referrers of targets and the test items they reach, outside targets and what is removed already."""
    off = under(items, targets.select("path").unionByName(removed.select("path"))).select("path").distinct()
    free = items.select("path").join(off, "path", "left_anti")
    inner = links.join(items.select(F.col("path").alias("src")), "src", "left_semi").join(free.select(F.col("path").alias("dst")), "dst", "left_semi")
    seeds = referrers(links, items, targets).select(F.lit(0).alias("root"), F.col("path").alias("node")).distinct()
    return closure(seeds, inner).select(F.col("node").alias("path")).distinct()


def shrink_scaffold(links: DataFrame, universe: DataFrame, targets: DataFrame, removed: DataFrame, items: DataFrame, prod: DataFrame, fixed: DataFrame, rounds: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survivors(path), demoted(path, reason), blocked(target, by)).

    A member stays while all it reaches and all that use it go too (or were removed); one that is `fixed` (can't be deleted)
    never does. A use of a production identity counts for a member that reaches it, uses of production items don't demote
    them. A target falls when one of its referrers does. Reasons in order: not-deletable, reaches-survivor, kept-by-survivor.
    """
    stay = cut(universe.select("path").unionByName(targets.select("path")).distinct())
    of = cut(referrers(links, items, targets))
    size = stay.count()
    gone_before = removed.select("path").distinct()
    demoted = None
    blocked = None
    for _ in range(rounds):
        ok = cut(covered(links, stay.select("path"), gone_before))
        m = universe.join(stay, "path", "left_semi")
        out = links.join(ok.select(F.col("path").alias("dst")), "dst", "left_anti").select(F.col("src").alias("path"), F.lit(2).alias("rank"))
        back = links.join(prod.select(F.col("path").alias("dst")), "dst", "left_anti").join(ok.select(F.col("path").alias("src")), "src", "left_anti").select(F.col("dst").alias("path"), F.lit(3).alias("rank"))
        why = fixed.select("path", F.lit(1).alias("rank")).unionByName(out).unionByName(back).groupBy("path").agg(F.min("rank").alias("rank"))
        bad = cut(m.join(why, "path").select("path", F.when(F.col("rank") == 1, "not-deletable").when(F.col("rank") == 2, "reaches-survivor").otherwise("kept-by-survivor").alias("reason")))
        stay = stay.join(bad.select("path"), "path", "left_anti")
        lost = of.join(stay, "path", "left_anti").groupBy("target").agg(F.min("path").alias("by"))
        fell = cut(targets.select(F.col("path").alias("target")).distinct().join(stay.withColumnRenamed("path", "target"), "target", "left_semi").join(lost, "target"))
        stay = cut(stay.join(fell.select(F.col("target").alias("path")), "path", "left_anti"))
        demoted = bad if demoted is None else cut(demoted.unionByName(bad))
        blocked = fell if blocked is None else cut(blocked.unionByName(fell))
        now = stay.count()
        if now == size:
            return stay, demoted, blocked
        size = now
    raise RuntimeError("scaffolding did not settle")


def covered(links: DataFrame, stay: DataFrame, removed: DataFrame) -> DataFrame:
    """(path) of all ends of links that go: members and targets with what is under them, and what is removed."""
    ends = links.select(F.col("src").alias("path")).unionByName(links.select(F.col("dst").alias("path"))).unionByName(stay).distinct()
    return under(ends, stay.unionByName(removed)).select("path").distinct()


def cleared_closure(links: DataFrame, of: DataFrame, universe: DataFrame, stay: DataFrame, blocked: DataFrame) -> DataFrame:
    """(target, path): for each target that is not blocked, the surviving members reached from its referrers. of(target, path)."""
    m = universe.join(stay, "path", "left_semi")
    inner = links.join(m.select(F.col("path").alias("src")), "src", "left_semi").join(m.select(F.col("path").alias("dst")), "dst", "left_semi")
    seeds = of.join(blocked.select("target"), "target", "left_anti").join(stay, "path", "left_semi").select(F.col("target").alias("root"), F.col("path").alias("node")).distinct()
    return closure(seeds, inner).select(F.col("root").alias("target"), F.col("node").alias("path"))
