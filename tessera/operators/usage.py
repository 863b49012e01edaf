"""Reference resolution, degrees and usage verdicts over definitions and reference edges.

Edges: key, external, test, config_id, and where needed src, own_impl, import_, trait_scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TEST_ONLY_CLASSES = ("CrossCrate", "DispatchReached", "IntraCrate", "TestOnly", "Unused")  # fixed values, strongest first


def distinct_edges(edges: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """One row for each edge identity, the one with the lowest span."""
    rest = [c for c in edges.columns if c not in identity]
    return edges.groupBy(*identity).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*identity, "_r.*")


def degrees(edges: DataFrame, by: list[str], external: Column | str = "external", test: Column | str = "test") -> DataFrame:
    """total, intra, test and test_intra counts by key, in one aggregation."""
    x, t = (F.col(c) if isinstance(c, str) else c for c in (external, test))
    return edges.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(~x).alias("intra"), F.count_if(t).alias("test"), F.count_if(t & ~x).alias("test_intra")
    )


def usage_class(d: dict[str, Column] | None = None) -> Column:
    """Class from OR-folded flags: prod_cross, any_cross, prod_intra, any_use, dispatch."""
    c = d or {n: F.col(n) for n in ("prod_cross", "any_cross", "prod_intra", "any_use", "dispatch")}
    return (
        F.when(c["prod_cross"] | (c["any_cross"] & c["prod_intra"]), "CrossCrate").when(c["dispatch"], "DispatchReached")
        .when(c["prod_intra"], "IntraCrate").when(c["any_use"], "TestOnly").otherwise("Unused")
    )


def usage_verdict(candidates: DataFrame, edges: DataFrame, key: str = "key", config: str = "config_id") -> DataFrame:
    """(key, usage): flags are folded by OR over configs before the class is chosen."""
    d = degrees(edges, [key, config])
    flags = d.groupBy(key).agg(
        F.bool_or((F.col("total") - F.col("intra")) > (F.col("test") - F.col("test_intra"))).alias("prod_cross"),
        F.bool_or(F.col("total") > F.col("intra")).alias("any_cross"),
        F.bool_or(F.col("intra") > F.col("test_intra")).alias("prod_intra"),
        F.bool_or(F.col("total") > 0).alias("any_use"),
    )
    base = candidates if "dispatch" in candidates.columns else candidates.withColumn("dispatch", F.lit(False))
    j = base.join(flags, key, "left")
    no = F.lit(False)
    return j.select(key, usage_class({n: F.coalesce(F.col(n), no) for n in ("prod_cross", "any_cross", "prod_intra", "any_use", "dispatch")}).alias("usage"))


def excluding(edges: DataFrame, removed: DataFrame, key: str = "src") -> DataFrame:
    """Edges that survive when the removed definitions go."""
    return edges.join(removed.select(key).distinct(), key, "left_anti")


def private_orphans(edges: DataFrame, removed: DataFrame, key: str = "key", src: str = "src") -> DataFrame:
    """Keys used before a removal and by nothing after it, themselves not removed."""
    gone = removed.select(F.col(src).alias(key))
    after = excluding(edges, removed, src).select(key).distinct()
    return edges.select(key).distinct().join(after, key, "left_anti").join(gone, key, "left_anti")


def covering_config(rows: DataFrame, crate: str, ordinal: str) -> DataFrame:
    return rows.groupBy(crate).agg(F.min(ordinal).alias("covering_ord"))


def identity_index(defs: DataFrame, key: str = "key", path: str = "path", ordinal: str = "config_ord") -> DataFrame:
    """Hash key to identity; the first config wins."""
    return defs.groupBy(key).agg(F.min_by(path, ordinal).alias("identity"))


def resolve(edges: DataFrame, local: DataFrame, index: DataFrame) -> DataFrame:
    """edges with `resolved`: local key, else identity's local key, else display path, else a unique suffix.

    edges(to_key, to_path); local(key, path); index(key, identity). Each leg is its own join.
    """
    own = local.select(F.col("key").alias("_k1"), F.col("key").alias("leg1"))
    by_path = local.groupBy("path").agg(F.min("key").alias("_k"))
    e = edges.join(own, F.col("to_key") == F.col("_k1"), "left").drop("_k1")
    ids = index.select(F.col("key").alias("_g"), F.col("identity").alias("_i"))
    e = e.join(ids, F.col("to_key") == F.col("_g"), "left").drop("_g")
    for leg, on in (("leg2", "_i"), ("leg3", "to_path")):
        e = e.join(by_path.select(F.col("path").alias(f"_{leg}"), F.col("_k").alias(leg)), F.col(on) == F.col(f"_{leg}"), "left").drop(f"_{leg}")
    last = lambda c: F.when(F.size(F.split(c, "::")) > 2, F.substring_index(c, "::", -2)).otherwise(F.substring_index(c, "::", -1))
    root = lambda c: F.substring_index(c, "::", 1)
    suffix = local.withColumn("_r", root("path")).withColumn("_t", last(F.col("path"))).groupBy("_r", "_t").agg(F.min("key").alias("leg4"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    e = e.withColumn("_r", root("to_path")).withColumn("_t", last(F.col("to_path"))).join(suffix, ["_r", "_t"], "left")
    return e.withColumn("resolved", F.coalesce("leg1", "leg2", "leg3", "leg4")).drop("_r", "_t", "_i")


def foreign_credit(edges: DataFrame, local: DataFrame, index: DataFrame) -> DataFrame:
    """Identity-level use from edges whose target this config lacks and the global index knows."""
    far = edges.join(local.select(F.col("key")), "key", "left_anti").join(index, "key")
    return far.groupBy("identity").agg(
        F.bool_or("external").alias("any_cross"), F.bool_or(~F.col("external")).alias("any_intra"), F.bool_or(F.col("external") & ~F.col("test")).alias("prod_cross"), F.bool_or(~F.col("external") & ~F.col("test")).alias("prod_intra")
    )


def union_verdict(candidates: DataFrame, reached: DataFrame, key: str = "key", ordinal: str = "config_ord") -> DataFrame:
    """(key, verdict, saver): lead (reached nowhere), retired (by the first non-primary config), or primary."""
    r = reached.groupBy(key).agg(F.bool_or(F.col(ordinal) == 0).alias("_p"), F.min(F.when(F.col(ordinal) > 0, F.col(ordinal))).alias("saver"))
    j = candidates.select(key).distinct().join(r, key, "left")
    verdict = F.when(F.col("_p").isNull(), "lead").when(F.col("_p"), "primary").otherwise("retired")
    return j.select(key, verdict.alias("verdict"), F.when(verdict == "retired", F.col("saver")).alias("saver"))


def test_users(edges: DataFrame, key: str = "key") -> DataFrame:
    return edges.where("test").groupBy(key).agg(F.sort_array(F.collect_set(F.struct("kind", "crate"))).alias("test_users"))


def externally_reachable(items: DataFrame, reexported: DataFrame) -> DataFrame:
    """(key, reachable): every ancestor module public, or re-exported by name. items(key, path, public, is_module)."""
    parts = F.split("path", "::")
    anc = items.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))).alias("a"))
    mods = items.select(F.col("path").alias("a"), F.col("public").alias("pub"))
    all_public = anc.join(mods, "a", "left").groupBy("key").agg(F.bool_and(F.coalesce("pub", F.lit(True))).alias("reachable"))
    ex = reexported.select("key", F.lit(True).alias("_x")).distinct()
    return all_public.join(ex, "key", "left").select("key", (F.col("reachable") | F.coalesce("_x", F.lit(False))).alias("reachable"))


def emptied_modules(children: DataFrame, removed: DataFrame) -> DataFrame:
    """Modules all of whose public children go (relational division). children(config_id, module, key)."""
    gone = removed.select("key", F.lit(True).alias("_g")).distinct()
    return children.join(gone, "key", "left").groupBy("config_id", "module").agg(F.bool_and(F.coalesce("_g", F.lit(False))).alias("emptied")).where("emptied").drop("emptied")


def dangling_imports(imports: DataFrame, removed: DataFrame, uses: DataFrame) -> DataFrame:
    """Imports of removed targets, or reached by removed code and by no survivor.

    imports(file, decl_lo, elem_lo, scope, target); uses(scope, target, from_removed).
    """
    by = uses.groupBy("scope", "target").agg(F.bool_or("from_removed").alias("_r"), F.bool_or(~F.col("from_removed")).alias("_s"))
    gone = removed.select(F.col("key").alias("target"), F.lit(True).alias("_g")).distinct()
    j = imports.join(gone, "target", "left").join(by, ["scope", "target"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return j.where(no("_g") | (no("_r") & ~no("_s"))).select(*imports.columns).dropDuplicates(["file", "decl_lo", "elem_lo"])


def merged_impl_blocks(blocks: DataFrame) -> DataFrame:
    """Impl blocks of all configs, merged on their span; blocks without a span stay apart."""
    some = blocks.where("lo is not null").groupBy("file", "lo", "hi", "self_key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return some.unionByName(blocks.where("lo is null").select("file", "lo", "hi", "self_key", "items"))


def first_rank(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
