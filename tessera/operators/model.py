"""The semantic model over definitions and reference edges: categories, candidates, degrees, reach, usage.

defs(cfg, key, path, krate, kind, parent_kind, trait_item, self_type, public, synthetic, export_root), one row a
definition and config; cfg is the config's ordinal, 0 the primary one. edges(cfg, krate, target_kind, is_test_cfg,
from_path, from_key, to_path, to_key, to_kind, external, import, reexport, glob, trait_scope, in_signature, own_key,
via); own_key is the self type of the impl the edge starts in (`with_own_key`). Paths are `::`-joined. `landed` edges
also have `key`, the definition of their own config they resolve to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .usage import degrees as count_degrees
from .usage import usage_class

# Kinds of units and definitions.
USAGE_ONLY = ("build", "test", "bench", "example")
JUDGED_KINDS = ("fn", "struct", "enum", "trait", "type", "const", "static", "macro", "union")
ADT_KINDS = ("struct", "enum", "union")


def no(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def parent(path: str | Column) -> Column:
    """The path without its last segment; empty for a single segment."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, "^(.*)::[^:]*$", 1)


def name_of(path: str) -> Column:
    return F.substring_index(path, "::", -1)


def category(parent_kind: Column, trait_item: Column) -> Column:
    return (
        F.when(parent_kind.isNull() | (parent_kind == "mod"), "module").when((parent_kind == "impl") & trait_item.isNotNull(), "trait-impl")
        .when(parent_kind == "impl", "inherent").otherwise("other")
    )


def supports_deletion(cat: Column) -> Column:
    return cat.isin("module", "inherent")


def is_test_unit(target_kind: Column, is_test_cfg: Column) -> Column:
    return (target_kind == "test") | is_test_cfg


def candidate_crates(fragments: DataFrame) -> DataFrame:
    """Crates a config may judge: those with a unit that is no test, bench, example or build script."""
    return fragments.where(~F.col("target_kind").isin(*USAGE_ONLY)).select("cfg", "krate").distinct()


def is_candidate(cat: Column) -> Column:
    return F.col("public") & ~F.col("synthetic") & (cat != "other") & F.col("kind").isin(*JUDGED_KINDS)


def with_own_key(edges: DataFrame, impls: DataFrame) -> DataFrame:
    """edges(cfg, unit_id, from_impl) with own_key from impls(cfg, unit_id, impl_ord, self_key)."""
    own = impls.select("cfg", "unit_id", F.col("impl_ord").alias("from_impl"), F.col("self_key").alias("own_key"))
    return edges.join(own, ["cfg", "unit_id", "from_impl"], "left")


def is_own_impl() -> Column:
    return no(F.col("own_key") == F.col("to_key"))


def edge_removed(edges: DataFrame, removed: DataFrame, defs: DataFrame) -> DataFrame:
    """edges with `gone`: the source lies in a removed path, or in an impl of a removed type. removed(path)."""
    from .graph import cut

    paths = removed.select(F.col("path").alias("_r")).distinct()
    parts = F.split("from_path", "::")
    at = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))
    e = cut(edges)
    # sources are judged once a path, not once an edge
    covered = e.select("from_path").distinct().select("from_path", F.explode(at).alias("_r")).join(paths, "_r").select("from_path").distinct().withColumn("_c", F.lit(True))
    types = defs.join(paths, F.col("path") == F.col("_r")).select("cfg", F.col("key").alias("own_key")).distinct().withColumn("_t", F.lit(True))
    e = join_some(e.join(covered, "from_path", "left"), types, ["cfg", "own_key"], "to_key")
    return e.withColumn("gone", no("_c") | no("_t")).drop("_c", "_t").select(*edges.columns, "gone")


def join_some(left: DataFrame, right: DataFrame, on: list[str], spread: str) -> DataFrame:
    """Left join by columns of which the last is often null: rows of null match nothing, and are spread over the tasks by another column."""
    salt = F.when(F.col(on[-1]).isNull(), F.xxhash64(spread)).otherwise(F.xxhash64(on[-1]))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", F.xxhash64(on[-1])), [*on, "_salt"], "left").drop("_salt")


def trait_parent(defs: DataFrame) -> DataFrame:
    """(cfg, key, trait_key): trait members with the trait that declares them."""
    at = defs.groupBy("cfg", F.col("path").alias("_p")).agg(F.min("key").alias("trait_key"))
    members = defs.where("parent_kind = 'trait'").select("cfg", "key", parent("path").alias("_p"))
    return members.join(at, ["cfg", "_p"]).select("cfg", "key", "trait_key")


def landed(edges: DataFrame, defs: DataFrame) -> DataFrame:
    """edges with `key` where their target's hash is a definition of their config, and that one's trait item."""
    own = defs.select("cfg", F.col("key").alias("to_key"), F.col("key"), "trait_item", F.col("krate").alias("to_krate"))
    return edges.join(own, ["cfg", "to_key"], "left")


def uses(land: DataFrame, defs: DataFrame) -> DataFrame:
    """(cfg, key, external, test, from_key) of each use: no import, no trait-scope fact, no own impl; a use of a trait's member is one of the trait too."""
    u = land.where("key is not null").where(~F.col("trait_scope") & ~F.col("import") & ~is_own_impl())
    u = u.select("cfg", "key", F.coalesce("trait_item", "key").alias("_m"), "external", is_test_unit(F.col("target_kind"), F.col("is_test_cfg")).alias("test"), "from_key")
    of = trait_parent(defs).withColumnRenamed("key", "_m")
    return u.drop("_m").unionByName(u.drop("key").join(of, ["cfg", "_m"]).withColumnRenamed("trait_key", "key").drop("_m"))


def fold(land: DataFrame, defs: DataFrame) -> DataFrame:
    """(cfg, key, total, intra, test, test_intra) of every used definition."""
    return count_degrees(uses(land, defs), ["cfg", "key"])


def foreign_reach(land: DataFrame, index: DataFrame) -> DataFrame:
    """(identity, cross, intra, prod_cross, prod_intra) of targets that only the global index(key, identity) knows."""
    far = land.where("key is null").where(~F.col("trait_scope") & ~F.col("import") & ~is_own_impl())
    test = is_test_unit(F.col("target_kind"), F.col("is_test_cfg"))
    j = far.drop("key").join(index.select(F.col("key").alias("to_key"), "identity"), "to_key")
    x = F.col("external")
    return j.groupBy("identity").agg(F.bool_or(x).alias("cross"), F.bool_or(~x).alias("intra"), F.bool_or(x & ~test).alias("prod_cross"), F.bool_or(~x & ~test).alias("prod_intra"))


def signature_exposed(land: DataFrame, defs: DataFrame) -> DataFrame:
    """(cfg, key) named in the signature of a public item, or of a member of a public trait."""
    pub = defs.where("public").select("cfg", F.col("key").alias("from_key"))
    of = trait_parent(defs)
    by_trait = of.join(pub.withColumnRenamed("from_key", "trait_key"), ["cfg", "trait_key"]).select("cfg", F.col("key").alias("from_key"))
    named = land.where("key is not null and in_signature and not trait_scope").where(~is_own_impl())
    return named.join(pub.unionByName(by_trait).distinct(), ["cfg", "from_key"], "left_semi").select("cfg", "key").distinct()


def reexports(land: DataFrame) -> DataFrame:
    """(cfg, key, module, glob) of every `pub use`."""
    r = land.where("key is not null and import and reexport and not trait_scope")
    return r.groupBy("cfg", "key", F.col("from_path").alias("module")).agg(F.bool_or("glob").alias("glob"))


def public_children(defs: DataFrame) -> DataFrame:
    """(cfg, module, key, path): public definitions by the path above them."""
    return defs.where("public").select("cfg", parent("path").alias("module"), "key", "path").where("module <> ''")


def reexported(land: DataFrame, defs: DataFrame) -> DataFrame:
    """(cfg, key, module, glob): re-exporting modules of each definition; one of a module counts for its public children."""
    own = reexports(land)
    mods = own.join(defs.where("kind = 'mod'").select("cfg", "key", "path"), ["cfg", "key"])
    mods = mods.join(mods.where("glob").select("cfg", "path").distinct().withColumn("_g", F.lit(True)), ["cfg", "path"], "left")
    kids = public_children(defs).select("cfg", F.col("module").alias("path"), F.col("key").alias("kid"))
    down = mods.join(kids, ["cfg", "path"]).select("cfg", F.col("kid").alias("key"), "module", no("_g").alias("glob"))
    return own.unionByName(down).groupBy("cfg", "key", "module").agg(F.bool_or("glob").alias("glob"))


def module_hop(paths: DataFrame, defs: DataFrame, path: str = "path") -> DataFrame:
    """(cfg, path, open): every known module on the path, itself included, is public; the crate's root always is."""
    mods = defs.where("kind = 'mod'").groupBy("cfg", F.col("path").alias("_m")).agg(F.max_by("public", "key").alias("_v"))
    p = paths.select("cfg", F.col(path).alias("path")).distinct()
    parts = F.split("path", "::")
    up = F.when(F.size(parts) >= 2, F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "::"))).otherwise(F.array().cast("array<string>"))
    hops = p.select("cfg", "path", F.explode_outer(up).alias("_m")).join(mods, ["cfg", "_m"], "left")
    return hops.groupBy("cfg", "path").agg(F.bool_and(F.coalesce("_v", F.lit(True))).alias("open"))


def externally_reachable(defs: DataFrame, exported: DataFrame) -> DataFrame:
    """(cfg, key, reachable): public with an open path, or re-exported from an open module; inherent items through their type."""
    hop = module_hop(defs, defs)
    via = exported.join(module_hop(exported, defs, "module").withColumnRenamed("path", "module"), ["cfg", "module"]).groupBy("cfg", "key").agg(F.bool_or("open").alias("_via"))
    d = defs.join(hop, ["cfg", "path"]).join(via, ["cfg", "key"], "left")
    inherent = category(F.col("parent_kind"), F.col("trait_item")) == "inherent"
    direct = d.select("cfg", "key", inherent.alias("_i"), "public", "self_type", (F.col("public") & (no("open") | no("_via"))).alias("_own"))
    of_type = direct.where("not _i").select("cfg", F.col("key").alias("self_type"), F.col("_own").alias("_type"))
    j = join_some(direct, of_type, ["cfg", "self_type"], "key")
    return j.select("cfg", "key", F.when(F.col("_i"), F.col("public") & no("_type")).otherwise(F.col("_own")).alias("reachable"))


def reach(defs: DataFrame, deg: DataFrame) -> DataFrame:
    """defs with `reach`: export root, direct, external or internal dispatch, or none."""
    used = deg.select("cfg", "key", F.lit(True).alias("_u"))
    known = defs.select("cfg", F.col("key").alias("trait_item"), F.lit(True).alias("_k"))
    by_trait = used.select("cfg", F.col("key").alias("trait_item"), F.lit(True).alias("_d"))
    d = defs.join(used, ["cfg", "key"], "left")
    d = join_some(d, known.join(by_trait, ["cfg", "trait_item"], "full"), ["cfg", "trait_item"], "key")
    r = (
        F.when(F.col("export_root"), "export-root").when(no("_u"), "direct").when(F.col("trait_item").isNotNull() & F.col("_k").isNull(), "external-dispatch")
        .when(F.col("trait_item").isNotNull() & no("_d"), "internal-dispatch").otherwise("unreached")
    )
    return d.withColumn("reach", r).select(*defs.columns, "reach")


def candidate_identities(reached: DataFrame) -> DataFrame:
    """(cfg, path, reached) of judged definitions, folded to their path. reached: defs with `reach`."""
    c = reached.where(is_candidate(category(F.col("parent_kind"), F.col("trait_item"))))
    return c.groupBy("cfg", "path").agg(F.bool_or(F.col("reach") != "unreached").alias("reached"))


def test_users(land: DataFrame, defs: DataFrame) -> DataFrame:
    """(cfg, key, kind, krate): who among the test units uses a definition, imports included, synthetic sources not."""
    made = defs.where("synthetic").select("cfg", F.col("key").alias("from_key"))
    t = land.where("key is not null and not trait_scope").where(is_test_unit(F.col("target_kind"), F.col("is_test_cfg"))).where(F.col("import") | ~is_own_impl())
    kind = (
        F.when(F.col("target_kind") == "test", "test-target").when(~F.col("external"), "own-unit-tests").when(F.col("target_kind") == "bin", "bin-unit-tests").otherwise("unit-tests")
    )
    krate = F.when(kind != "own-unit-tests", F.col("krate"))
    return t.join(made, ["cfg", "from_key"], "left_anti").select("cfg", "key", kind.alias("kind"), krate.alias("krate")).distinct()


def pub_usage(defs: DataFrame, land: DataFrame, fragments: DataFrame, index: DataFrame | None = None, removed_uses: DataFrame | None = None) -> DataFrame:
    """(path, usage, signature_exposed, externally_reachable, reexport_target, intra_off_home) of every candidate.

    Folds flags over keys and configs by OR; a crate's home is the first config that may judge it. Expansions
    (from_expansion) and crates no config judges are no candidates. `removed_uses` replaces the uses counted.
    """
    home = candidate_crates(fragments).groupBy("krate").agg(F.min("cfg").alias("home"))
    deg = count_degrees(removed_uses if removed_uses is not None else uses(land, defs), ["cfg", "key"])
    d = reach(defs, deg).where(is_candidate(category(F.col("parent_kind"), F.col("trait_item"))) & ~no("from_expansion")).join(home, "krate")
    d = d.join(deg, ["cfg", "key"], "left").fillna(0, ["total", "intra", "test", "test_intra"])
    exposed = signature_exposed(land, defs).withColumn("_s", F.lit(True))
    target = land.where("key is not null and import and reexport and not trait_scope").select("cfg", "key", F.lit(True).alias("_t")).distinct()
    d = d.join(exposed, ["cfg", "key"], "left").join(target, ["cfg", "key"], "left").join(externally_reachable(defs, reexported(land, defs)), ["cfg", "key"], "left")
    c = F.col
    f = d.groupBy("path").agg(
        F.bool_or(c("total") > c("intra")).alias("cross"), F.bool_or(c("intra") > 0).alias("intra"), F.bool_or(c("total") - c("intra") > c("test") - c("test_intra")).alias("prod_cross"),
        F.bool_or(c("intra") > c("test_intra")).alias("prod_intra"), F.bool_or((c("intra") > 0) & (c("cfg") == c("home"))).alias("intra_home"),
        F.bool_or(c("reach").isin("external-dispatch", "internal-dispatch", "export-root")).alias("dispatch"), F.bool_or(no("_s")).alias("signature_exposed"),
        F.bool_or(no("reachable")).alias("externally_reachable"), F.bool_or(no("_t")).alias("reexport_target"),
    )
    if index is not None:
        far = foreign_reach(land, index).select(F.col("identity").alias("path"), *[F.col(x).alias(f"_f{x}") for x in ("cross", "intra", "prod_cross", "prod_intra")])
        f = f.join(far, "path", "left")
        for x in ("cross", "intra", "prod_cross", "prod_intra"):
            f = f.withColumn(x, F.col(x) | no(f"_f{x}"))
    usage = usage_class({"prod_cross": c("prod_cross"), "any_cross": c("cross"), "prod_intra": c("prod_intra"), "any_use": c("cross") | c("intra"), "dispatch": c("dispatch")})
    off = c("intra") & ~c("intra_home") & ~c("cross")
    return f.select("path", usage.alias("usage"), "signature_exposed", "externally_reachable", "reexport_target", off.alias("intra_off_home"))


def uses_without(land: DataFrame, defs: DataFrame, removed: DataFrame) -> DataFrame:
    """The uses that survive a removal of paths; edges of removed sources and of impls of removed types go."""
    return uses(edge_removed(land, removed, defs).where("not gone").drop("gone"), defs)


def references_from(edges: DataFrame, defs: DataFrame) -> DataFrame:
    """(cfg, krate, module, target, to_kind, import, glob, file, lo) of edges out of primary units, targets by definition path."""
    e = edges.where(~F.col("target_kind").isin("test", "build") & ~F.col("in_signature") & ~F.col("trait_scope"))
    own = defs.select("cfg", F.col("key").alias("to_key"), F.col("path").alias("_to"))
    e = e.join(own, ["cfg", "to_key"], "left").withColumn("target", F.coalesce("_to", "to_path"))
    return enclosing_module(e, defs).select("cfg", "krate", "module", "target", "to_kind", "import", "glob", "file", "lo")


def enclosing_module(rows: DataFrame, defs: DataFrame, path: str = "from_path") -> DataFrame:
    """rows with `module`: the longest prefix of two segments or more that is a module of the config, else the crate's root."""
    mods = defs.where("kind = 'mod'").select("cfg", F.col("path").alias("_m")).distinct()
    p = rows.select("cfg", F.col(path).alias("_p")).distinct()
    parts = F.split("_p", "::")
    up = p.where(F.size(parts) >= 2).select("cfg", "_p", F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "::"))).alias("_n", "_m"))
    best = up.join(mods, ["cfg", "_m"]).groupBy("cfg", "_p").agg(F.max_by("_m", "_n").alias("_best"))
    j = rows.withColumn("_p", F.col(path)).join(best, ["cfg", "_p"], "left")
    return j.withColumn("module", F.coalesce("_best", F.substring_index(path, "::", 1))).drop("_best", "_p")


def skipped_by_filters(cat: Column, usage: Column, skipped_scope: Column, exempt: Column) -> Column:
    """A candidate that is no finding; columns path, reexport_target, signature_exposed, externally_reachable."""
    main = (name_of("path") == "main") & (F.size(F.split("path", "::")) == 2)
    return ~supports_deletion(cat) | main | skipped_scope | (F.col("reexport_target") & (usage != "Unused")) | F.col("signature_exposed") | (exempt & F.col("externally_reachable"))


def scope_skips(kinds: list[str] | None, allow: list[str], exclude: list[str], target_dir: str, path: Column, kind: Column, file: Column, generated: Column) -> Column:
    """Kind filter, allowed paths, build output, generated files and excluded file globs; without a file only the first two."""
    from ..functions.paths import any_glob

    skip = ~kind.isin(*kinds) if kinds is not None else F.lit(False)
    skip = skip | any_glob(F.replace(path, F.lit("::"), F.lit("/")), [x.replace("::", "/") for x in allow])
    by_file = file.startswith(target_dir.rstrip("/") + "/") | F.coalesce(generated, F.lit(False)) | any_glob(file, exclude)
    return skip | F.coalesce(by_file, F.lit(False))


def crate_excluded(member: Column, code: Column, excluded: list[str]) -> Column:
    """By the package's name or the crate's code form."""
    return (member.isin(*excluded) | code.isin(*excluded)) if excluded else F.lit(False)


def exempt_external(publish: Column, assume_all_public: bool = False) -> Column:
    """publish: true, false, a list of registries as text, or null."""
    return F.lit(assume_all_public) | F.coalesce(publish.isin("true", "registries"), F.lit(False))


def publish_hints(findings: DataFrame, exempt: DataFrame, threshold: int) -> DataFrame:
    """(krate, visible, silenced) of crates with many findings that are not silenced. findings(krate, suppressed); exempt(krate)."""
    n = findings.join(exempt.select("krate").distinct(), "krate", "left_anti").groupBy("krate").agg(F.count_if(~F.col("suppressed")).alias("visible"), F.count_if("suppressed").alias("silenced"))
    return n.where((F.lit(threshold) > 0) & (F.col("visible") >= threshold))


def exercised(fragments: DataFrame, edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, crate) named by a member's units: roots of targets and of written paths (`via`). owners(krate, owner)."""
    e = edges.where("not trait_scope").join(owners, "krate")
    named = e.select("owner", F.explode(F.array(F.substring_index("to_path", "::", 1), "via")).alias("crate"))
    return named.where("crate is not null and crate <> owner").distinct()


def resolver_used(used: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, crate) the resolver marked. used(krate, value)."""
    return used.join(owners, "krate").where("value <> owner").select("owner", F.col("value").alias("crate")).distinct()


def compiled_members(fragments: DataFrame, owners: DataFrame) -> DataFrame:
    return fragments.join(owners, "krate").select("owner").distinct()


def dep_partition(entries: DataFrame, verdicts: DataFrame, credited: DataFrame) -> DataFrame:
    """(member, alias, section, status) of manifest entries that are unused or whose member was not compiled.

    entries(member, alias, package, section, kind); verdicts(member, name, kind, verdict), names in code form;
    credited(member, name): names that the text itself uses, met with or without separators.
    """
    from ..functions.paths import code_name, separator_stripped

    e = entries.withColumn("name", code_name(F.coalesce("package", "alias"))).withColumn("_a", code_name(F.col("alias")))
    c = credited.select("member", F.col("name").alias("_a")).distinct()
    e = e.join(c, ["member", "_a"], "left_anti").withColumn("_a", separator_stripped(F.col("_a"))).join(c, ["member", "_a"], "left_anti")
    j = e.join(verdicts.where(F.col("verdict").isin("unused", "not-compiled")).select("member", "name", "kind", F.col("verdict").alias("status")).distinct(), ["member", "name", "kind"])
    return j.select("member", "alias", "section", "status")


def fragment_values(rows: DataFrame) -> DataFrame:
    """The distinct values of loaded_file or used_crate over all configs."""
    return rows.select("value").distinct()


def prod_identities(fragments_of_defs: DataFrame) -> DataFrame:
    """Paths that a unit which is no test defines. Columns path, target_kind, is_test_cfg."""
    return fragments_of_defs.where(~is_test_unit(F.col("target_kind"), F.col("is_test_cfg"))).select("path").distinct()
