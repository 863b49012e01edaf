"""Dependency, layering, budget, drift, orphan and configuration verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .graph import closure


def dep_verdict(decls: DataFrame, used: DataFrame, resolver: DataFrame, pkg_dep: DataFrame, compiled: DataFrame, test_members: DataFrame, lib_name: DataFrame | None = None) -> DataFrame:
    """decls with `verdict`: the first exemption that holds, else used or unused.

    decls(member, name, kind, optional, target_gated); used(member, crate) exercised crates; resolver
    (member, crate) exact names; pkg_dep(pkg, dep); compiled(member); test_members(member).
    """
    seeds = decls.select(F.col("name").alias("root"), F.col("name").alias("node")).distinct()
    reach = closure(seeds, pkg_dep, "pkg", "dep")
    if lib_name is not None:  # each node stands under its package and its library name
        reach = reach.unionByName(reach.join(lib_name.select(F.col("pkg").alias("node"), "lib"), "node").select("root", F.col("lib").alias("node")))
    reach = reach.select(F.col("root").alias("name"), P.code_name(F.col("node")).alias("crate"))
    by_closure = used.join(reach, "crate").select("member", "name").distinct()
    exact = resolver.select("member", F.col("crate").alias("_c")).distinct()
    d = decls.join(by_closure.withColumn("_u", F.lit(True)), ["member", "name"], "left")
    d = d.join(exact.withColumn("_e", F.lit(True)), (d.member == exact.member) & (P.code_name(d["name"]) == F.col("_c")), "left").drop(exact.member).drop("_c")
    d = d.join(compiled.select("member", F.lit(True).alias("_k")).distinct(), "member", "left")
    d = d.join(test_members.select("member", F.lit(True).alias("_t")).distinct(), "member", "left")
    verdict = (
        F.when(F.col("optional"), "optional").when(F.col("target_gated"), "target-gated").when(F.col("kind") == "build", "build")
        .when((F.col("kind") == "dev") & F.col("_t").isNull(), "dev-without-tests").when(F.col("_k").isNull(), "not-compiled")
        .when(F.col("_u").isNotNull() | F.col("_e").isNotNull(), "used").otherwise("unused")
    )
    return d.withColumn("verdict", verdict).select(*decls.columns, "verdict")


def _matches(globs: list[str]):
    return lambda x: P.any_glob(x, globs)


def layering(refs: DataFrame, rules: list[dict], order=("file", "lo")) -> DataFrame:
    """Violations of layering rules. refs(module, target, pass_no, file, lo); rule: name, from, deny, except.

    A target is matched by any of its prefixes of two segments or more. Within a rule and module each
    claimed target is reported once: by the earliest pass, then the first place (nulls first).
    """
    active = [r for r in rules if r.get("deny") and r.get("level", "warn") != "allow"]
    norm = lambda p: p.replace("-", "_").replace("::", "/")
    form = lambda c: P.glob_form(c)
    pre = F.transform(P.canonical_prefixes(F.split("target", "::")), P.segments_glob_form)
    found = None
    for r in active:
        deny, spare = [norm(x) for x in r["deny"]], [norm(x) for x in r.get("except", [])]
        hit = refs.where(P.any_glob(form(F.col("module")), [norm(x) for x in r["from"]]))
        prefixes = pre if not spare else F.when(P.any_glob(form(F.col("target")), spare), F.array().cast("array<string>")).otherwise(pre)
        hit = hit.withColumn("claim", F.get(F.filter(prefixes, _matches(deny)), F.lit(0))).where("claim is not null")
        hit = hit.withColumn("rule", F.lit(r["name"]))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return refs.limit(0).withColumns({"claim": F.lit(""), "rule": F.lit("")})
    from pyspark.sql.window import Window

    w = Window.partitionBy("rule", "module", "claim").orderBy("pass_no", *[F.col(c).asc_nulls_first() for c in order], "target")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def over_budget(files: DataFrame, rules: list[tuple[str, int]], path: str = "path", lines: str = "lines") -> DataFrame:
    """(path, lines, glob, most) for each rule a file exceeds; strictly greater."""
    each = [F.when(P.any_glob(F.col(path), [g]) & (F.col(lines) > n), F.struct(F.lit(g).alias("glob"), F.lit(n).cast("long").alias("most"))) for g, n in rules]
    if not each:
        return files.limit(0)
    return files.select(path, lines, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("r")).select(path, lines, "r.*")


def group_over_budget(files: DataFrame, group: str, lines: str, most: int) -> DataFrame:
    return files.groupBy(group).agg(F.sum(lines).alias("total")).where(F.col("total") > most)


def shipped_lines(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Code lines of each file outside its test ranges. lines(file, line, is_code); ranges(file, lo, hi) inclusive and disjoint or not."""
    test = ranges.select("file", F.explode(F.sequence("lo", "hi")).alias("line")).distinct()
    return lines.join(test, ["file", "line"], "left_anti").groupBy("file").agg(F.count_if("is_code").alias("lines"))


def feature_drift(declared: DataFrame, used: DataFrame) -> DataFrame:
    """(crate, feature, drift): declared but never gated (leaf features only), and gated but undeclared.

    declared(crate, feature, activates array); used(crate, feature).
    """
    u = used.select("crate", "feature").distinct()
    never = declared.where(~F.col("feature").isin("default", "") & (F.size("activates") == 0)).join(u, ["crate", "feature"], "left_anti")
    undeclared = u.join(declared, ["crate", "feature"], "left_anti")
    return never.select("crate", "feature", F.lit("declared-never-gated").alias("drift")).unionByName(undeclared.withColumn("drift", F.lit("gated-undeclared")))


def default_features(entries: DataFrame) -> DataFrame:
    """(crate, feature) in the closure of `default` over bare entries. entries(crate, feature, entry)."""
    bare = entries.where(~F.col("entry").startswith("dep:") & ~F.col("entry").contains("/"))
    name = lambda f: F.concat_ws("\x00", "crate", f)
    seeds = entries.where("feature = 'default'").select(F.col("crate").alias("root"), name(F.col("feature")).alias("node")).distinct()
    edges = bare.select(name(F.col("feature")).alias("src"), name(F.col("entry")).alias("dst"))
    return closure(seeds, edges).select(F.col("root").alias("crate"), F.element_at(F.split("node", "\x00"), 2).alias("feature"))


def centralized(deps: DataFrame, shared: DataFrame) -> DataFrame:
    """Inline dependencies and, where all inline versions agree and the workspace has none, a seed.

    deps(member, name, version, default_features, uses_workspace, is_path); shared(name).
    """
    inline = deps.where(~F.col("uses_workspace") & ~F.col("is_path"))
    agree = inline.groupBy("name").agg((F.count_distinct(F.struct("version", "default_features")) == 1).alias("agree"))
    known = shared.select("name", F.lit(True).alias("shared")).distinct()
    j = inline.join(agree, "name").join(known, "name", "left")
    return j.withColumn("seed", F.col("agree") & F.col("shared").isNull()).select(*inline.columns, F.coalesce("shared", F.lit(False)).alias("shared"), "seed")


def orphan_files(files: DataFrame, opened: DataFrame, declared: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(path, verdict): live if the compiler opened it, coverage-gap if only declared, else orphan."""
    f = files if members is None else files.join(members, "member", "left_semi")
    j = f.join(opened.select("path", F.lit(True).alias("_o")).distinct(), "path", "left").join(declared.select("path", F.lit(True).alias("_d")).distinct(), "path", "left")
    return j.select("path", F.when(F.col("_o"), "live").when(F.col("_d"), "coverage-gap").otherwise("orphan").alias("verdict"))


def version_mismatch(tools: DataFrame, lock: DataFrame, pattern: str) -> DataFrame:
    """(tool, found, locked) where the captured version differs. tools(tool, crate, output); lock(pos, crate, version), the first entry of a crate counts."""
    first = lock.groupBy("crate").agg(F.min_by("version", "pos").alias("locked"))
    j = tools.withColumn("found", P.extract_version(F.col("output"), pattern)).join(first, "crate")
    return j.where(~F.col("found").eqNullSafe(F.col("locked"))).select("tool", "found", "locked")


def missing(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(present, on, "left_anti")


def missing_everywhere(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Expected rows that no directory of their group holds. present may name several directories."""
    return expected.join(present.select(*on).distinct(), on, "left_anti")


def newest_copy(fragments: DataFrame, by: list[str], stamp: str = "mtime") -> DataFrame:
    """One fragment of each name over all configs: the one written last (then the greatest path)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(F.col(stamp).desc(), F.col("path").desc())
    return fragments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def retained_generations(generations: DataFrame, current: int, previous: int) -> DataFrame:
    """The current generation and the newest `previous` others. A top-k of one folder's few generations. generations(n)."""
    others = generations.where(F.col("n") != current).orderBy(F.col("n").desc()).limit(previous)
    return generations.where(F.col("n") == current).unionByName(others)


def stale_entries(cache: DataFrame, keep: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Entries idle for more than the limit: not the kept one, and with a mark of their last use. cache(name, last_used)."""
    return cache.where((F.col("name") != keep) & F.col("last_used").isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp("last_used") > ttl_seconds))


def member_closure(roots: DataFrame, edges: DataFrame, members: DataFrame, tests: bool, all_features: bool) -> DataFrame:
    """(member) a scoped config compiles: from its roots over normal and build edges between members, dev edges from roots if tests are
    built, optional ones unless features are the default. edges(src, dst, kind, optional)."""
    root = roots.select(F.col("member").alias("src"), F.lit(True).alias("_root")).distinct()
    inside = edges.join(members.select(F.col("member").alias("dst")), "dst", "left_semi").join(root, "src", "left")
    follow = F.when(F.col("kind") == "dev", F.lit(tests) & F.col("_root").isNotNull() & ~F.col("optional")).otherwise(~F.col("optional") | F.lit(all_features))
    seeds = roots.join(members, "member", "left_semi").select(F.lit(0).alias("root"), F.col("member").alias("node")).distinct()
    return closure(seeds, inside.where(follow).select("src", "dst")).select(F.col("node").alias("member")).distinct()


def incomplete_groups(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(universe, missing): fragments that no config of a universe group has. expected(universe, name); present(universe, name)."""
    return missing_everywhere(expected, present, ["universe", "name"]).groupBy("universe").agg(F.sort_array(F.collect_set("name")).alias("missing"))


def effective_level(explicit: Column, crate_lint: Column, crate_default: Column, global_lint: Column, global_default: Column, is_meta: Column) -> Column:
    """Level cascade; an `allow` default never hides a meta lint."""
    floor = lambda c: F.when(is_meta & (c == "allow"), "warn").otherwise(c)
    return F.coalesce(explicit, crate_lint, floor(crate_default), global_lint, floor(global_default), F.lit("warn"))
