"""Regions that no configuration compiles, and who can see them.

regions(rid, file, krate, lo, hi, text); a region is shadowed unless some config evaluates its predicate to true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import code_name
from .graph import closure, cut

LINKS = 1_000_000  # members and links that the walk of dependents holds in one task

# Operating system, family and environment by what stands in a target triple, first match wins.
SYSTEMS = (
    ("darwin", "macos", "unix", ""), ("ios", "ios", "unix", ""), ("android", "android", "unix", ""), ("linux", "linux", "unix", None), ("windows", "windows", "windows", None),
    ("wasi", "wasi", "wasm", ""),
)


def triple_axes(triple: Column) -> Column:
    """arch, os, family and env of a target triple; what is not known is null."""
    arch, rest = F.substring_index(triple, "-", 1), F.regexp_replace(triple, "^[^-]*-?", "")
    env = {"linux": F.when(rest.contains("musl"), "musl").otherwise("gnu"), "windows": F.when(rest.contains("gnu"), "gnu").otherwise("msvc")}
    axes = {"os": F.lit(None).cast("string"), "family": F.lit(None).cast("string"), "env": F.lit(None).cast("string")}
    rules = [(rest.contains(k), o, f, e) for k, o, f, e in SYSTEMS] + [(arch.startswith("wasm"), "unknown", "wasm", ""), (rest.contains("freebsd"), "freebsd", "unix", "")]
    for test, o, f, e in reversed(rules):
        axes = {"os": F.when(test, o).otherwise(axes["os"]), "family": F.when(test, f).otherwise(axes["family"]), "env": F.when(test, env[o] if e is None else F.lit(e)).otherwise(axes["env"])}
    return F.struct(arch.alias("arch"), *[v.alias(k) for k, v in axes.items()])


def atom(key: Column, value: Column, axes: Column, tests: Column, features: Column, declared: Column, defaults: Column, all_features: Column, no_default: Column) -> Column:
    """A cfg atom under a config: true, false, or null where nothing is known. A feature that is off is null, never false.

    Flags have a null value. features, declared and defaults are arrays.
    """
    axis = lambda name, want: F.when(axes[name].isNull(), F.lit(None).cast("boolean")).otherwise(axes[name] == want)
    on = F.array_contains(features, value) | (all_features & F.array_contains(declared, value)) | (~no_default & F.array_contains(defaults, value))
    pair = F.when(key == "target_arch", axis("arch", value)).when(key == "target_os", axis("os", value)).when(key == "target_family", axis("family", value)).when(key == "target_env", axis("env", value))
    pair = pair.when((key == "feature") & on, True)
    flag = F.when(key == "unix", axis("family", "unix")).when(key == "windows", axis("family", "windows")).when(key == "test", tests).when(key == "debug_assertions", True)
    return F.when(value.isNull(), flag).otherwise(pair)


def shadowed(regions: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Regions that no config evaluates to true. evaluated(rid, cfg, value)."""
    return regions.join(evaluated.where("value").select("rid").distinct(), "rid", "left_anti")


def dependents(members: DataFrame, deps: DataFrame) -> DataFrame:
    """(krate, member), code names: members whose dependencies reach the crate, itself included. members(member); deps(member, name)."""
    inner = cut(deps.join(members.select(F.col("member").alias("name")), "name", "left_semi").select(F.col("member").alias("src"), F.col("name").alias("dst")).distinct())
    named = cut(members.select("member", code_name(F.col("member")).alias("code")).distinct())
    n = named.count()
    if n + inner.count() <= LINKS:
        return walked(named, inner)
    seeds = named.select(F.col("member").alias("root"), F.col("member").alias("node"))
    return closure(seeds, inner, rounds=n + 1).select(code_name(F.col("node")).alias("krate"), code_name(F.col("root")).alias("member")).distinct()


def walked(named: DataFrame, inner: DataFrame, cells: int = 32_000_000, least: int = 48) -> DataFrame:
    """(krate, member) as `dependents` has them, of links that fit a task: tasks walk from blocks of members, a deep chain in one go.

    named(member, code), distinct; inner(src, dst), distinct. A block marks what it has seen in at most `cells` bytes.
    """
    import numpy as np

    spark = named.sparkSession
    rows = named.toArrow().to_pydict()
    codes = sorted(set(rows["code"]), key=lambda c: (c is None, c or ""))
    code, at = {c: i for i, c in enumerate(codes)}, {m: i for i, m in enumerate(rows["member"])}
    label = np.array([code[c] for c in rows["code"]], dtype=np.int64)
    links = inner.toArrow().to_pydict()
    pairs = np.array([(at[a], at[b]) for a, b in zip(links["src"], links["dst"]) if a is not None and a in at], dtype=np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    first = np.searchsorted(pairs[:, 0], np.arange(len(label) + 1))
    by_code = np.argsort(label, kind="stable")
    size = max(1, min(cells // max(1, len(label)), -(-len(codes) // least)))
    known = spark.sparkContext.broadcast((codes, label, pairs[:, 1].copy(), first, by_code))

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        codes, label, dst, first, by_code = known.value
        n, names, ends = len(label), pa.array(codes, pa.string()), np.searchsorted(label[by_code], np.arange(len(codes) + 1))
        for batch in batches:
            for block in batch.column(0).to_pylist():
                lo, hi = block * size, min((block + 1) * size, len(codes))
                node = by_code[ends[lo] : ends[hi]]
                front = (label[node] - lo) * n + node
                seen = np.zeros((hi - lo) * n, dtype=bool)
                seen[front] = True
                while len(front):
                    node = front % n
                    count = first[node + 1] - first[node]
                    start = np.repeat(first[node] - (np.cumsum(count) - count), count)
                    to = np.repeat(front - node, count) + dst[start + np.arange(len(start))]
                    front = np.unique(to[~seen[to]])
                    seen[front] = True
                for root in range(hi - lo):
                    found = np.unique(label[np.flatnonzero(seen[root * n : (root + 1) * n])])
                    for i in range(0, len(found), 100_000):
                        part = found[i : i + 100_000]
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(part)), names.take(pa.array(np.full(len(part), lo + root)))], ["krate", "member"])

    blocks = -(-len(codes) // size)
    return spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(walk, "krate string, member string")


def mentions(candidates: DataFrame, regions: DataFrame, visible: DataFrame) -> DataFrame:
    """(path, rid): the first region, of a crate that can see the candidate, that names it.

    candidates(path, krate, parent, name); parent is null for items of modules, which are met as whole words; members of a type
    as `Parent::name`, `.name(` or `.name::<`. An equi join on the words of the text, then the exact test.
    """
    words = regions.select("rid", F.col("krate").alias("member"), "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))).alias("name"))
    j = candidates.join(words, "name").join(visible, ["krate", "member"], "left_semi")
    dotted = F.col("text").contains(F.concat("parent", F.lit("::"), "name")) | F.col("text").contains(F.concat(F.lit("."), "name", F.lit("("))) | F.col("text").contains(F.concat(F.lit("."), "name", F.lit("::<")))
    return j.where(F.col("parent").isNull() | dotted).groupBy("path").agg(F.min("rid").alias("rid"))


def overlapping(ranges: DataFrame, regions: DataFrame, width: int = 4096) -> DataFrame:
    """(id, rid): the first region of the same file that overlaps each range(id, file, lo, hi). Both are dealt to cells; half open."""
    cell = lambda d: d.where("hi > lo").withColumn("_c", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    r = cell(regions.select("rid", "file", "lo", "hi")).select("rid", "file", "_c", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return cell(ranges).join(r, ["file", "_c"]).where("_lo < hi and lo < _hi").groupBy("id").agg(F.min("rid").alias("rid"))
