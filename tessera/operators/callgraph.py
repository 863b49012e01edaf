"""Call-graph queries over landed edges and definitions (see `model`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import no


def target_identity(land: DataFrame, defs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """landed edges with `identity`: the definition's path, else what the global index(key, identity) knows."""
    own = defs.select("cfg", "key", F.col("path").alias("_own"))
    e = land.join(own, ["cfg", "key"], "left")
    if index is None:
        return e.withColumnRenamed("_own", "identity")
    far = index.select(F.col("key").alias("to_key"), F.col("identity").alias("_far"))
    return e.join(far, "to_key", "left").withColumn("identity", F.coalesce("_own", "_far")).drop("_own", "_far")


def covered_out(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """edges with `identity_of`: those of each wanted(path) and of definitions nested under it. An equi join on prefixes."""
    parts = F.split("from_path", "::")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))
    return edges.withColumn("identity_of", F.explode(up)).join(wanted.select(F.col("path").alias("identity_of")).distinct(), "identity_of")


def callees(identified: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, target, kind, resolved): distinct call targets of each wanted definition; imports, trait-scope facts and parameters are none."""
    e = covered_out(identified, wanted).where((F.col("to_kind") != "param") & ~F.col("import") & ~F.col("trait_scope"))
    return e.select(F.col("identity_of").alias("path"), F.coalesce("identity", "to_path").alias("target"), F.col("to_kind").alias("kind"), F.col("identity").isNotNull().alias("resolved")).distinct()


def references_to(identified: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, from_path, file, lo, import, in_signature): distinct inbound references of each wanted(path)."""
    e = identified.join(wanted.select(F.col("path").alias("identity")).distinct(), "identity")
    return e.select(F.col("identity").alias("path"), "from_path", "file", "lo", "import", "in_signature").distinct()


def functions_by_file(defs: DataFrame) -> DataFrame:
    """(file, path, krate, lo, hi, trait_method): written functions, the first config's for each file and path."""
    f = defs.where("kind = 'fn' and lo is not null").where(~no("from_expansion"))
    methods = defs.select("cfg", F.col("key").alias("trait_item"), F.col("path").alias("trait_method"))
    f = f.join(methods, ["cfg", "trait_item"], "left")
    return f.groupBy("file", "path").agg(F.min_by(F.struct("krate", "lo", "hi", "trait_method"), F.struct("cfg", "key")).alias("s")).select("file", "path", "s.*")


def call_edges(identified: DataFrame) -> DataFrame:
    """(caller, callee, n): the call graph, calls counted."""
    e = identified.where((F.col("to_kind") != "param") & ~F.col("import") & ~F.col("trait_scope")).where("identity is not null")
    return e.groupBy(F.col("from_path").alias("caller"), F.col("identity").alias("callee")).agg(F.count("*").alias("n"))


def same_callees(members: DataFrame, calls: DataFrame) -> DataFrame:
    """(gid, same): all members of a clone group call the same targets. members(gid, path); calls as of `callees`."""
    sets = members.join(calls, "path", "left").groupBy("gid", "path").agg(F.array_sort(F.collect_set(F.struct("target", "kind", "resolved"))).alias("s"))
    return sets.groupBy("gid").agg((F.count_distinct(F.to_json("s")) == 1).alias("same"))


def dead_copies(members: DataFrame, inbound: DataFrame) -> DataFrame:
    """(gid, path) of members without a reference from outside their group, where some other member has one. inbound(path, from_path)."""
    mine = members.select("gid", F.col("path").alias("from_path"), F.lit(True).alias("_in"))
    outside = members.join(inbound.select("path", "from_path"), "path").join(mine, ["gid", "from_path"], "left").where("_in is null").select("gid", "path", F.lit(True).alias("_live")).distinct()
    m = members.select("gid", "path").distinct().join(outside, ["gid", "path"], "left")
    live = m.groupBy("gid").agg(F.count_if("_live").alias("_n")).where("_n > 0")
    return m.where("_live is null").join(live, "gid", "left_semi").select("gid", "path")
