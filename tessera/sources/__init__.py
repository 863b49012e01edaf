"""Sources and sinks of the fact tables: schemas, readers with checks, text scanners and writers."""

from __future__ import annotations

import json
import shlex
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 16  # fixed value
SPAN = "struct<file:string,lo:bigint,hi:bigint,line:bigint,from_expansion:boolean>"
UNIT = "config_id string, config_ord int, unit_id string"
SCHEMAS = {
    "fragment": f"{UNIT}, schema_version int, crate_name string, target_kind string, is_test_cfg boolean",
    "item": f"{UNIT}, path array<string>, key string, kind string, parent_kind string, trait_item string, self_type string, visibility struct<tag:string,scope:string>, span {SPAN}, full_span {SPAN}, vis_span {SPAN}, attrs array<string>, self_kind string, self_copy boolean",
    "ref_edge": f"{UNIT}, from array<string>, to array<string>, from_module array<string>, from_key string, to_key string, to_kind string, external boolean, receiver_resolved boolean, import boolean, in_signature boolean, reexport boolean, glob boolean, trait_scope boolean, extern_root boolean, alias string, via string, glob_used_names array<string>, span {SPAN}, decl_span {SPAN}, elem_span {SPAN}, from_impl int",
    "impl_fact": f"{UNIT}, impl_ord int, self_key string, origin string, of_trait boolean, full_span {SPAN}, items array<string>",
    "loaded_file": f"{UNIT}, value string",
    "used_crate": f"{UNIT}, value string",
    "dep_decl": "member string, name string, kind string, optional boolean, target_gated boolean",
    "pkg_dep": "pkg string, dep string",
    "target_owner": "target string, owner string",
}


def read_facts(spark: SparkSession, root: str, name: str, configs: list[str] | None = None) -> DataFrame:
    """One fact table with its fixed schema; configs prune partitions. Fragments are checked."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")
    if configs is not None:
        df = df.where(F.col("config_id").isin(configs))
    if name == "fragment":
        bad = df.agg(F.count("*"), F.count_if(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)))).first()
        if not bad[0]:
            raise ValueError(f"no fragments under {root}")
        if bad[1]:
            raise ValueError(f"{bad[1]} fragments have another schema version than {SCHEMA_VERSION}")
        df = df.orderBy("crate_name", "target_kind")
    return df


def write_facts(df: DataFrame, root: str, name: str) -> None:
    """Published as a whole by the committer; only the configs in df are replaced."""
    want = T._parse_datatype_string(SCHEMAS[name])
    df.select(*[F.col(f.name).cast(f.dataType) for f in want]).write.option("partitionOverwriteMode", "dynamic").partitionBy(*[c for c in ("config_id",) if c in want.names]).mode("overwrite").parquet(f"{root}/{name}")


def keep_fragments(df: DataFrame, keep: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keep, on, "left_semi")


def metadata_tables(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """member, target, dep_decl and pkg_dep from metadata JSON (one workspace, read on the driver)."""
    md = json.loads(text)
    members = {p["id"]: p["name"] for p in md["packages"] if p["id"] in set(md.get("workspace_members", []))}
    decl = [(p["name"], d["name"], d.get("kind") or "normal", bool(d.get("optional")), d.get("target") is not None) for p in md["packages"] if p["id"] in members for d in p.get("dependencies", [])]
    names = {p["id"]: p["name"] for p in md["packages"]}
    deps = [(names[n["id"]], names[d]) for n in (md.get("resolve") or {}).get("nodes", []) for d in n.get("dependencies", []) if d in names]
    targets = [(t["name"], p["name"], k, t.get("src_path")) for p in md["packages"] if p["id"] in members for t in p.get("targets", []) for k in t.get("kind", [])]
    return {
        "member": spark.createDataFrame([(x,) for x in members.values()], "member string"),
        "target": spark.createDataFrame(targets, "target string, owner string, kind string, src string"),
        "dep_decl": spark.createDataFrame(decl, SCHEMAS["dep_decl"]),
        "pkg_dep": spark.createDataFrame(deps, SCHEMAS["pkg_dep"]),
    }


def manifest_deps(text: str) -> list[dict]:
    """Declared dependencies of one manifest: the three sections and target-gated tables."""
    doc = tomllib.loads(text)
    out = []

    def section(table: dict, gated: bool):
        for kind, name in (("normal", "dependencies"), ("dev", "dev-dependencies"), ("build", "build-dependencies")):
            for key, entry in table.get(name, {}).items():
                e = {"version": entry} if isinstance(entry, str) else entry
                out.append({"name": e.get("package", key), "key": key, "kind": kind, "version": e.get("version"), "optional": e.get("optional", False), "uses_workspace": e.get("workspace", False), "is_path": "path" in e, "is_git": "git" in e, "default_features": e.get("default-features", True), "target_gated": gated})

    section(doc, False)
    for table in doc.get("target", {}).values():
        section(table, True)
    return out


def lock_packages(text: str) -> list[tuple[str, str]]:
    return [(p["name"], p["version"]) for p in tomllib.loads(text).get("package", [])]


def publish_state(manifest: dict) -> bool | None:
    """Tri-state: None when not stated."""
    p = manifest.get("package", {}).get("publish")
    return None if p is None or isinstance(p, dict) else (len(p) > 0 if isinstance(p, list) else bool(p))


def parse_command(entry: str) -> dict:
    """A cargo command as a config; an unknown token is an error."""
    words = shlex.split(entry)
    spec = {"verb": None, "tests": False, "features": [], "all_features": False, "no_default_features": False, "package": [], "target": None, "profile": None}
    if words[:1] == ["cargo"]:
        words = words[1:]
    if not words or words[0] not in ("check", "build", "test", "clippy", "bench"):
        raise ValueError(f"unknown command: {entry}")
    spec["verb"], it = words[0], iter(words[1:])
    spec["tests"] = words[0] == "test"
    for w in it:
        flag, _, value = w.partition("=")
        take = lambda v=value: v or next(it, "")
        if flag in ("--tests", "--all-targets"):
            spec["tests"] = True
        elif flag == "--features":
            spec["features"] += [x for x in take().replace(",", " ").split() if x]
        elif flag == "--all-features":
            spec["all_features"] = True
        elif flag == "--no-default-features":
            spec["no_default_features"] = True
        elif flag in ("-p", "--package"):
            spec["package"].append(take())
        elif flag == "--target":
            spec["target"] = take()
        elif flag in ("--release", "--workspace", "--lib", "--bins"):
            spec["profile"] = "release" if flag == "--release" else spec["profile"]
        else:
            raise ValueError(f"unknown token {w} in: {entry}")
    return spec


def universe_key(spec: dict) -> str:
    return "|".join(str(spec[k]) for k in ("target", "profile", "no_default_features", "all_features")) + "|" + ",".join(sorted(spec["features"]))


def text_files(spark: SparkSession, root: str, glob: str = "*.rs") -> DataFrame:
    """(path, content) of the tree, without target and hidden folders."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    df = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return df.where(~F.col("path").rlike("/target/|/\\.[^/]+/"))


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """files exploded to (…, line, text), lines from 1."""
    rest = [c for c in files.columns if c != content]
    return files.select(*rest, F.posexplode(F.split(content, "\n")).alias("_p", "text")).select(*rest, (F.col("_p") + 1).alias("line"), "text")


DIRECTIVE = "tessera-lint:\\s*(allow|expect)(-file)?\\(([^)]*)\\)"


def directives(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Comment directives: (did, kind, scope, lint, file, line)."""
    found = lines(files.select(F.col(path).alias("file"), F.col(content).alias("content"))).where(F.col("text").rlike(DIRECTIVE))
    found = found.select(
        "file", "line", F.regexp_extract("text", DIRECTIVE, 1).alias("kind"), F.when(F.regexp_extract("text", DIRECTIVE, 2) != "", "file").otherwise("line").alias("scope"),
        F.explode(F.split(F.regexp_extract("text", DIRECTIVE, 3), "\\s*,\\s*")).alias("lint"),
    )
    return found.select(F.xxhash64("file", "line", "lint").alias("did"), "kind", "scope", F.trim("lint").alias("lint"), "file", "line")


def doc_fence_refs(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(file, crate): heads of paths and `use` in fenced code of doc comments."""
    from pyspark.sql.window import Window

    body = lines(files.select(F.col(path).alias("file"), F.col(content).alias("content"))).where(F.col("text").rlike("^\\s*//[/!]"))
    body = body.withColumn("b", F.regexp_replace("text", "^\\s*//[/!] ?", ""))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("n", F.sum(F.col("b").rlike("^\\s*```").cast("int")).over(w))
    code = body.where("n % 2 = 1").where(~F.col("b").rlike("^\\s*```"))
    return code.select("file", F.explode(F.regexp_extract_all("b", F.lit("\\b([a-z_][a-z0-9_]*)::"), F.lit(1))).alias("crate")).distinct()


def cfg_regions(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(file, line, predicate, features) of each cfg attribute."""
    found = lines(files.select(F.col(path).alias("file"), F.col(content).alias("content"))).withColumn("predicate", F.regexp_extract("text", "#!?\\[cfg\\((.*)\\)\\]", 1))
    from ..functions.paths import feature_names

    return found.where("predicate <> ''").select("file", "line", "predicate", feature_names(F.col("predicate")).alias("features"))


def replace_between(text, start: str, end: str, body: str):
    """text with what stands between two markers replaced; unchanged where a marker is missing."""
    q = lambda s: "\\Q" + s + "\\E"
    return F.regexp_replace(text, f"(?s)({q(start)}).*?({q(end)})", "$1" + body.replace("\\", "\\\\").replace("$", "\\$") + "$2")


def write_baseline(groups: DataFrame, path: str) -> None:
    """In order of place, over as many files as the sort has ranges; their names keep the order."""
    groups.orderBy("file", "line", "fp").write.mode("overwrite").json(path)


def write_lines(rendered: DataFrame, path: str) -> None:
    rendered.write.mode("overwrite").text(path)
