"""Imports that a removal leaves without use: scopes, glob chains, evidence, whole-statement globs.

identified edges (see `callgraph.target_identity`) with crate = the first segment of from_path, from_module, decl
(file, decl_lo, decl_expansion), elem_lo, glob_used_names, receiver_resolved, extern_root, from_expansion and `gone`
(the removal takes the edge). Evidence is (crate, scope, id) or (crate, scope, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure
from .model import no

KEY = ["crate", "scope"]


def prefixes(path: Column) -> Column:
    parts = F.split(path, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))


def scopes(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """edges with `scope`: each prefix of from_path, longest first, down to the nearest module or the crate's root.

    modules(cfg, path). With from_module that module ends the walk and is a scope itself. An edge gives a row a scope.
    """
    e = edges.withColumn("_e", F.monotonically_increasing_id())
    from .graph import cut

    e = cut(e)
    up = e.select("_e", "cfg", "from_path", "from_module", F.posexplode(prefixes(F.col("from_path"))).alias("_n", "scope"))
    m = modules.select("cfg", F.col("path").alias("scope"), F.lit(True).alias("_m")).distinct()
    up = up.join(m, ["cfg", "scope"], "left")
    lexical = F.col("from_module").isNotNull() & (F.col("from_module") != "")
    stop = F.when(lexical & (F.col("scope") == F.col("from_module")), True).when(F.col("_n") == 0, True).otherwise(no("_m") & (F.col("scope") != F.col("from_path")))
    last = up.groupBy("_e").agg(F.max(F.when(stop, F.col("_n"))).alias("_stop"))
    # without a lexical module the place where the walk stops is a scope too
    walk = up.join(last, "_e").where((F.col("_n") > F.col("_stop")) | (~lexical & (F.col("_n") == F.col("_stop")))).select("_e", "scope")
    own = e.where(lexical).select("_e", F.col("from_module").alias("scope"))
    return e.join(walk.unionByName(own).distinct(), "_e").drop("_e")


def glob_chains(globs: DataFrame) -> DataFrame:
    """(crate, scope, importer): scopes that import a module's names by globs, directly or through others. globs(crate, module, importer)."""
    node = lambda c: F.concat_ws("\x00", "crate", c)
    edges = globs.select(node("module").alias("src"), node("importer").alias("dst"))
    seeds = globs.select(node("module").alias("root"), node("importer").alias("node")).distinct()
    reached = closure(seeds, edges)
    part = lambda c, i: F.element_at(F.split(c, "\x00"), i)
    return reached.select(part("root", 1).alias("crate"), part("root", 2).alias("scope"), part("node", 2).alias("importer"))


def probes(wanted: DataFrame, evidence: DataFrame) -> DataFrame:
    """wanted(crate, scope, id) rows that some evidence of their scope names, itself or something under it."""
    under = evidence.select(*KEY, F.explode(prefixes(F.col("id"))).alias("id")).distinct()
    return wanted.join(under, [*KEY, "id"], "left_semi")


def reaches(wanted: DataFrame, evidence: DataFrame, chains: DataFrame, own_imports: DataFrame) -> DataFrame:
    """wanted rows reached at their scope, or from a scope whose globs lead there and that does not import the id itself."""
    w = wanted.select(*KEY, "id").distinct()
    direct = probes(w, evidence)
    far = w.join(chains, KEY).select("crate", F.col("importer").alias("scope"), "id", F.col("scope").alias("_at"))
    mine = probes(far.select(*KEY, "id").distinct(), own_imports)
    far = far.join(mine, [*KEY, "id"], "left_anti")
    far = far.join(probes(far.select(*KEY, "id").distinct(), evidence), [*KEY, "id"], "left_semi").select("crate", F.col("_at").alias("scope"), "id")
    return direct.unionByName(far).distinct()


def import_usage(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(crate, scope, id, by_removed, by_survivor): what the uses of each scope name, split by the removal."""
    body = edges.where("not trait_scope and not import and not in_signature")
    s = scopes(body, modules).select(*KEY, F.coalesce("identity", "to_path").alias("id"), "gone")
    return s.groupBy(*KEY, "id").agg(F.bool_or("gone").alias("by_removed"), F.bool_or(~F.col("gone")).alias("by_survivor"))


def dangling_leaves(edges: DataFrame, modules: DataFrame, removed: DataFrame, generated: DataFrame) -> DataFrame:
    """(file, decl_lo, elem_lo, reexport): leaves whose target goes, or that removed code used and no survivor does."""
    leaf = edges.where("import and decl_lo is not null and elem_lo is not null").join(generated.select(F.col("path").alias("file")), "file", "left_anti")
    leaf = leaf.select("file", "decl_lo", "elem_lo", "reexport", "crate", F.col("from_path").alias("scope"), F.coalesce("identity", "to_path").alias("id"))
    usage = import_usage(edges, modules)
    decl = edges.where("import and not trait_scope")
    globs = decl.where("glob").select("crate", F.coalesce("identity", "to_path").alias("module"), F.col("from_path").alias("importer")).distinct()
    mine = decl.where("not glob").select("crate", F.col("from_path").alias("scope"), F.coalesce("identity", "to_path").alias("id")).distinct()
    chains = glob_chains(globs)
    hit = lambda flag, out: reaches(leaf, usage.where(flag), chains, mine).withColumn(out, F.lit(True))
    gone = removed.select(F.col("path").alias("id"), F.lit(True).alias("_g")).distinct()
    j = leaf.join(gone, "id", "left").join(hit("by_removed", "_r"), [*KEY, "id"], "left").join(hit("by_survivor", "_s"), [*KEY, "id"], "left")
    some = j.where(no("_g") | (~F.col("reexport") & no("_r") & ~no("_s")))
    return some.groupBy("file", "decl_lo", "elem_lo").agg(F.bool_or("reexport").alias("reexport"))


def unattributable() -> Column:
    """An outside target that may have come through any glob. Kinds and roots that can't."""
    root = F.substring_index("to_path", "::", 1)
    return ~F.col("extern_root") & ~F.col("receiver_resolved") & ~F.col("to_kind").isin("macro", "param") & ~root.isin("std", "core", "alloc")


def dangling_globs(edges: DataFrame, modules: DataFrame, generated: DataFrame) -> DataFrame:
    """(file, decl_lo): glob imports that only removed code leaned on. Each rule fails towards keeping."""
    decl = edges.where("import and glob and decl_lo is not null and not decl_expansion and not reexport").join(generated.select(F.col("path").alias("file")), "file", "left_anti")
    g = decl.groupBy("file", "decl_lo").agg(
        F.min("crate").alias("crate"), F.min("from_path").alias("scope"), F.min(F.coalesce("identity", "to_path")).alias("id"), F.array_distinct(F.flatten(F.collect_list("glob_used_names"))).alias("used")
    )
    every = edges.where("import and not trait_scope")
    chains = glob_chains(every.where("glob").select("crate", F.coalesce("identity", "to_path").alias("module"), F.col("from_path").alias("importer")).distinct())
    mine = every.where("not glob").select("crate", F.col("from_path").alias("scope"), F.coalesce("identity", "to_path").alias("id")).distinct()
    traits = scopes(edges.where("trait_scope"), modules).select(*KEY, F.coalesce("identity", "to_path").alias("id"), "gone").distinct()
    usage = import_usage(edges, modules)
    body = scopes(edges.where("not trait_scope and not import and not in_signature"), modules)
    blind = F.col("extern_root") & no("from_expansion")
    names = body.where(~blind).select(*KEY, F.explode(F.split(F.coalesce("identity", "to_path"), "::")).alias("name"), "gone").where("name <> ''").distinct()
    vague = body.where("identity is null and not gone").where(unattributable()).select(*KEY).distinct()
    none = mine.limit(0)
    flag = lambda d, evidence, own, out: d.join(reaches(d, evidence, chains, own).withColumn(out, F.lit(True)), [*KEY, "id"], "left")
    j = flag(flag(flag(g, traits.where("gone"), none, "_tr"), traits.where("not gone"), none, "_ts"), usage.where("by_survivor"), mine, "_s")
    at = g.select(*KEY).distinct()
    reach_of = at.select(*KEY, F.col("scope").alias("_at")).unionByName(at.join(chains, KEY).select("crate", F.col("importer").alias("scope"), F.col("scope").alias("_at")))
    seen = reach_of.join(names, KEY).groupBy("crate", F.col("_at").alias("scope")).agg(F.collect_set(F.when(F.col("gone"), F.col("name"))).alias("_rn"), F.collect_set(F.when(~F.col("gone"), F.col("name"))).alias("_sn"))
    open_ = reach_of.join(vague, KEY).select("crate", F.col("_at").alias("scope"), F.lit(True).alias("_v")).distinct()
    j = j.join(seen, KEY, "left").join(open_, KEY, "left")
    met = lambda c: F.coalesce(F.arrays_overlap("used", c), F.lit(False))
    alive = (F.size("used") > 0) | no("_tr") | no("_ts")
    return j.where(alive & ~no("_s") & ~no("_ts") & ~met("_sn") & (no("_tr") | met("_rn")) & ~no("_v")).select("file", "decl_lo")


def excision_blocked(edges: DataFrame, generated: DataFrame) -> DataFrame:
    """(identity, reason): targets of imports that no edit can take out; a macro's output outranks a generated file."""
    made = generated.select(F.col("path").alias("file"), F.lit(True).alias("_f")).distinct()
    j = edges.where("import and decl_lo is not null and identity is not null").join(made, "file", "left").where(F.col("decl_expansion") | no("_f"))
    macro = F.bool_or("decl_expansion")
    return j.groupBy("identity").agg(F.when(macro, "macro-generated").otherwise("generated-file").alias("reason"))
