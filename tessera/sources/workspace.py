"""Workspace sources: nested fragments, module files, line kinds, gated regions, settings with their audit, version control, commands."""

from __future__ import annotations

import subprocess
import tomllib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.findings import unknown
from ..operators.graph import cut

# Sections of the settings with their keys and those of their rules.
SECTIONS = {
    "file-size": (("rules",), ("glob", "max-code-lines")),
    "crate-size": (("rules",), ("glob", "max-code-lines", "include")),
    "cli-crate-version": (("rules",), ("command", "pattern", "crate")),
    "architecture": (("rules",), ("name", "from", "deny", "exceptions", "severity", "reason", "suggest")),
    "expand": (("rules",), ("command", "glob", "marker", "auto-stage")),
    "duplicate-code": (("min-lines", "min-tokens", "min-instances", "ignore-literals", "ignore-test-code", "cross-crate-only", "min-distinct-anchors", "min-non-repeating-ratio", "max-parameters", "max-live-out", "classify", "component-macros", "baseline", "include", "exclude"), None),
    "unused-deps": (("ignore",), None),
    "unused-pub": (("exclude-crates", "allowlist", "kinds", "exclude-paths", "suppress-intra-crate", "assume-all-public", "publish-hint-threshold"), None),
    "engine": (("configs",), None),
}
PER_CRATE = ("lints", "unused-deps", "unused-pub")  # fixed values


# ---- fragments


def child_rows(fragments: DataFrame, child: str) -> DataFrame:
    """One child table of nested fragments: an array of structs or of texts, exploded with its place in the fragment."""
    keys = [c for c in ("config_id", "config_ord", "unit_id", "crate_name", "target_kind", "is_test_cfg") if c in fragments.columns]
    rows = fragments.select(*keys, F.posexplode(child).alias("ord", "_r"))
    struct = dict(rows.dtypes)["_r"].startswith("struct")
    return rows.select(*keys, "ord", "_r.*") if struct else rows.select(*keys, "ord", F.col("_r").alias("value"))


def loaded_files(fragments: DataFrame, package_dirs: DataFrame) -> DataFrame:
    """(crate_name, value): files a unit opened inside its own package. package_dirs(crate_name, dir)."""
    f = child_rows(fragments, "loaded_files").join(package_dirs, "crate_name")
    return f.where(F.col("value").startswith(F.concat(F.regexp_replace("dir", "/$", ""), F.lit("/")))).select("crate_name", "value").distinct()


def deduplicated(edges: DataFrame) -> DataFrame:
    """Edges of a unit once by what they connect and their flags, the one with the lowest place. The identity's columns."""
    from ..operators.usage import distinct_edges

    identity = ["unit_id", "from_path", "to_path", "from_key", "to_key", "to_kind", "external", "receiver_resolved", "import", "in_signature", "reexport", "glob", "trait_scope", "extern_root"]
    return distinct_edges(edges, [c for c in identity if c in edges.columns], ["file", "lo"])


def dump(rows: DataFrame) -> DataFrame:
    """Rows as JSON text, one a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


# ---- modules and lines


def bare(content: Column) -> Column:
    """Source text with comments and string literals blanked."""
    strings = F.regexp_replace(content, '(?s)b?r(#*)".*?"\\1|b?"(?:\\\\.|[^"\\\\])*"', '""')
    return F.regexp_replace(strings, "(?s)//[^\\n]*|/\\*.*?\\*/", " ")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def module_files(files: DataFrame, roots: DataFrame, rounds: int = 1000) -> DataFrame:
    """(root, path, parent, mod_dir): files that `mod x;` declarations reach from each target's root, level by level.

    files(path, content); roots(root). `#[path]` counts from the declaring file's folder, x from the module's folder: x.rs, else
    x/mod.rs. Declarations inside inline modules count as their file's. A file is taken once a root, so cycles end.
    """
    have = cut(files.select("path", "content"))
    paths = have.select("path")
    stem = F.regexp_extract("path", "([^/]*)\\.rs$", 1)
    own_dir = F.when(stem.isin("lib", "main", "mod") | F.col("parent").isNull(), _folder(F.col("path"))).otherwise(F.concat(_folder(F.col("path")), F.lit("/"), stem))
    front = cut(roots.select("root", F.col("root").alias("path"), F.lit(None).cast("string").alias("parent")).join(paths, "path", "left_semi").select("root", "path", "parent").withColumn("mod_dir", own_dir))
    seen = front
    for _ in range(rounds):
        text = front.join(have, "path")
        plain = F.regexp_replace(F.regexp_replace("content", "(?s)//[^\\n]*|/\\*.*?\\*/", " "), "\\s+", " ")
        found = text.select("root", F.col("path").alias("parent"), "mod_dir", F.explode(F.regexp_extract_all(plain, F.lit('((?:#\\[path = "[^"]*"\\] ?)?(?:#\\[[^\\]]*\\] ?)*(?:pub(?:\\([^)]*\\))? )?mod [A-Za-z_0-9]+ ?;)'), F.lit(1))).alias("d"))
        name, over = F.regexp_extract("d", "mod ([A-Za-z_0-9]+) ?;", 1), F.regexp_extract("d", 'path = "([^"]*)"', 1)
        options = F.when(over != "", F.array(F.concat(_folder(F.col("parent")), F.lit("/"), over))).otherwise(F.array(F.concat("mod_dir", F.lit("/"), name, F.lit(".rs")), F.concat("mod_dir", F.lit("/"), name, F.lit("/mod.rs"))))
        each = found.select("root", "parent", "d", F.posexplode(options).alias("n", "path")).join(paths, "path", "left_semi")
        first = each.groupBy("root", "parent", "d").agg(F.min_by("path", "n").alias("path")).select("root", "path", "parent").dropDuplicates(["root", "path"])
        front = cut(first.withColumn("mod_dir", own_dir).join(seen.select("root", "path"), ["root", "path"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError("modules did not settle")


def included_files(files: DataFrame, env: dict[str, str]) -> DataFrame:
    """(file, target): what `include!` names, a text or concat!(env!("NAME"), "text"); unknown variables give none."""
    text = F.regexp_extract_all("content", F.lit('include!\\(\\s*((?:concat!\\()?[^;]*?)\\)\\s*;'), F.lit(1))
    each = files.select(F.col("path").alias("file"), F.explode(text).alias("a"))
    var, tail, plain = F.regexp_extract("a", 'env!\\("([^"]*)"\\)', 1), F.regexp_extract("a", '"\\)\\s*,\\s*"([^"]*)"', 1), F.regexp_extract("a", '^"([^"]*)"', 1)
    known = F.lit(None).cast("string")
    for k, v in env.items():
        known = F.when(var == k, F.lit(v)).otherwise(known)
    return each.select("file", F.when(plain != "", F.concat(_folder(F.col("file")), F.lit("/"), plain)).otherwise(F.concat(known, tail)).alias("target")).where("target is not null")


def line_kinds(files: DataFrame) -> DataFrame:
    """(path, line, kind): code, comment or blank of every line. Block comments nest; text in literals is no comment."""
    clean = F.regexp_replace("content", 'b?"(?:\\\\.|[^"\\\\\\n])*"', '""')
    rows = files.select("path", F.posexplode(F.split(clean, "\n")).alias("_p", "t"))
    marks = F.regexp_extract_all("t", F.lit("(/\\*|\\*/)"), F.lit(1))
    opened = F.size(F.filter(marks, lambda m: m == "/*")) - F.size(F.filter(marks, lambda m: m == "*/"))
    w = Window.partitionBy("path").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("d", F.coalesce(F.sum(opened).over(w), F.lit(0)))
    inside = F.col("d") > 0
    rest = F.when(inside, F.regexp_replace("t", "^.*?\\*/", "")).otherwise(F.col("t"))
    rest = F.when(inside & ~F.col("t").contains("*/"), "").otherwise(F.regexp_replace(F.regexp_replace(rest, "/\\*.*?(\\*/|$)", ""), "//.*$", ""))
    kind = F.when(F.trim("t") == "", "blank").when(F.regexp_like(rest, F.lit("\\S")), "code").otherwise("comment")
    return rows.select("path", (F.col("_p") + 1).alias("line"), kind.alias("kind"))


def gated_regions(files: DataFrame) -> DataFrame:
    """(path, lo, hi, predicate): bytes from each `#[cfg(...)]` to the end of the item it stands on (a closed brace or a semicolon)."""

    def work(batches):
        for pdf in batches:
            out = []
            for path, text in zip(pdf.path, pdf.content, strict=True):
                src, at = text or "", 0
                while (at := src.find("#[cfg(", at)) >= 0:
                    start, i, depth = at, at + 6, 1
                    while i < len(src) and depth:
                        depth += (src[i] == "(") - (src[i] == ")")
                        i += 1
                    predicate, end, depth = src[at + 6 : i - 1], src.find("]", i - 1) + 1 or len(src), 0
                    while end < len(src):
                        c = src[end]
                        if c == '"':
                            end = src.find('"', end + 1)
                            end = len(src) - 1 if end < 0 else end
                        depth += (c in "{([") - (c in "})]")
                        end += 1
                        if depth <= 0 and (c == ";" or c == "}"):
                            break
                    out.append((path, len(src[:start].encode()), len(src[:end].encode()), predicate))
                    at = i
            yield pd.DataFrame(out, columns=["path", "lo", "hi", "predicate"])

    return files.select("path", "content").mapInPandas(work, "path string, lo long, hi long, predicate string")


def macro_directives(files: DataFrame, marker: str = "tessera_lint") -> DataFrame:
    """(file, line, kind, lint) of directives written as macros."""
    rows = files.select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("_p", "t"))
    pattern = f"\\b{marker}::(allow|expect)!\\s*[\\(\\[{{]([^)\\]}}]*)"
    found = rows.where(F.col("t").rlike(pattern)).select("file", (F.col("_p") + 1).alias("line"), F.regexp_extract("t", pattern, 1).alias("kind"), F.explode(F.split(F.regexp_extract("t", pattern, 2), "\\s*,\\s*")).alias("lint"))
    return found.select("file", "line", "kind", F.replace(F.trim("lint"), F.lit("_"), F.lit("-")).alias("lint")).where("lint <> ''")


# ---- settings


def settings_rows(spark: SparkSession, text: str) -> DataFrame:
    """(context, key): every key of a settings file in the tables that are audited. One small file, read on the driver."""
    doc, rows = tomllib.loads(text), []
    for section, value in doc.items():
        rows.append(("", section))
        if section == "crates" and isinstance(value, dict):
            for crate, block in value.items():
                rows.append(("crates", crate))
                for key, sub in (block if isinstance(block, dict) else {}).items():
                    rows.append((f"crates.{crate}", key))
                    rows += [(f"crates.{crate}.{key}", k) for k in sub] if isinstance(sub, dict) else []
        elif isinstance(value, dict):
            rows += [(section, k) for k in value]
            rules = value.get("rules")
            rows += [(f"{section}.rules", k) for r in (rules if isinstance(rules, list) else []) if isinstance(r, dict) for k in r]
    return spark.createDataFrame(rows, "context string, key string")


def allowed_keys(spark: SparkSession, lints: list[str]) -> DataFrame:
    """(context, key): what each table of the settings may hold. Per-crate tables stand under `crates.*`."""
    rows = [("", k) for k in (*SECTIONS, "lints", "crates")] + [("lints", k) for k in ("default", *lints)] + [("crates.*", k) for k in PER_CRATE] + [("crates.*.lints", k) for k in ("default", *lints)]
    for name, (keys, rule) in SECTIONS.items():
        rows += [(name, k) for k in keys] + [(f"{name}.rules", k) for k in rule or ()]
        rows += [(f"crates.*.{name}", k) for k in keys] if name in PER_CRATE else []
    return spark.createDataFrame(rows, "context string, key string")


def unknown_keys(rows: DataFrame, allowed: DataFrame, members: DataFrame) -> DataFrame:
    """(context, key, suggestion) of keys no table may hold and of crates that are no members, with the nearest allowed name. members(member)."""
    general = F.regexp_replace("context", "^crates\\.[^.]+", "crates.*")
    r = rows.withColumn("table", general).distinct()
    known = allowed.select(F.col("context").alias("table"), "key").unionByName(members.select(F.lit("crates").alias("table"), F.col("member").alias("key")))
    audited = r.join(known.select("table").distinct(), "table", "left_semi")
    # a name may be known in one table and not in another, so names carry their table
    tag = lambda d: d.withColumn("name", F.concat_ws("\x00", "table", "key"))
    odd = unknown(tag(audited).select("name").distinct(), tag(known).select("name"))
    same = F.substring_index("suggestion", "\x00", 1) == F.substring_index("name", "\x00", 1)
    odd = odd.select("name", F.when(same, F.substring_index("suggestion", "\x00", -1)).alias("suggestion"))
    return tag(audited).join(odd, "name").select("context", "key", "suggestion")


def load_settings(text: str) -> dict:
    """The settings with per-crate tables: a crate's table replaces the general one as a whole."""
    doc = tomllib.loads(text)
    crates = doc.pop("crates", {})
    return {"general": doc, "crates": {c: {**doc, **block} for c, block in crates.items()}}


def primary_after_scoped(specs: list[dict]) -> bool:
    """The first command is scoped to a target or package though a later one builds the whole workspace."""
    scoped = [bool(s.get("target") or s.get("package")) for s in specs]
    return bool(scoped) and scoped[0] and not all(scoped)


def unique_configs(specs: list[dict]) -> list[dict]:
    """Commands that mean the same are one config; the first stays."""
    seen: dict[str, dict] = {}
    for s in specs:
        seen.setdefault(repr(sorted((k, sorted(v) if isinstance(v, list) else v) for k, v in s.items())), s)
    return list(seen.values())


# ---- baseline, version control, commands


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(fp, n_tokens, n_instances, file, line) of a recorded baseline; a key recorded twice is an error."""
    df = spark.read.schema("fp string, n_tokens int, n_instances int, file string, line int, kind string, lines int").json(path)
    twice = df.groupBy("fp", "n_tokens").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"baseline {path} records {twice[0].fp} with {twice[0].n_tokens} tokens twice")
    return df


def file_states(spark: SparkSession, root: str) -> DataFrame:
    """(path, state): clean or dirty of each tracked file of a work tree; an empty table where there is none. Anything absent is untracked."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=False)
    listed = run("ls-files", "-z")
    if listed.returncode:
        return spark.createDataFrame([], "path string, state string")
    dirty = {x[3:] for x in run("status", "--porcelain", "-z").stdout.split("\0") if x}
    return spark.createDataFrame([(p, "dirty" if p in dirty else "clean") for p in listed.stdout.split("\0") if p], "path string, state string")


def command_output(argv: list[str], cwd: str | None = None, limit: int = 60) -> str | None:
    """What a command prints; None where it fails."""
    try:
        done = subprocess.run(argv, cwd=cwd, capture_output=True, text=True, timeout=limit, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def tool_outputs(spark: SparkSession, rules: list[dict], cwd: str | None = None) -> DataFrame:
    """(tool, crate, output): one row a rule(command, crate), run on the driver."""
    rows = [(r["command"], r["crate"], command_output(r["command"].split(), cwd)) for r in rules]
    return spark.createDataFrame(rows, "tool string, crate string, output string")


def expanded(files: DataFrame, start: str, end: str, argv: list[str], cwd: str | None = None) -> DataFrame:
    """files(path, content) with what stands between two markers replaced by a command's output; unchanged where it fails."""
    from . import replace_between

    body = command_output(argv, cwd)
    return files if body is None else files.withColumn("content", replace_between(F.col("content"), start, end, body))


def complete(read: Callable[[], DataFrame], expected: DataFrame, on: list[str], again: Callable[[DataFrame], None]) -> DataFrame:
    """What `read` gives, after one forced rerun for what is missing; still missing rows are an error."""
    lost = expected.join(read(), on, "left_anti")
    if not lost.isEmpty():
        again(lost)
        left = expected.join(read(), on, "left_anti").limit(5).collect()
        if left:
            raise ValueError(f"fragments missing after a second run: {[tuple(r) for r in left]}")
    return read()


#: Providers of fact tables by name: a function of (spark, location, table).
PROVIDERS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {
    "parquet": lambda spark, at, name: spark.read.parquet(f"{at}/{name}"),
    "json": lambda spark, at, name: spark.read.json(f"{at}/{name}"),
}


def provide(spark: SparkSession, kind: str, at: str, name: str) -> DataFrame:
    """A fact table from an interchangeable source."""
    if kind not in PROVIDERS:
        raise ValueError(f"unknown source {kind}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[kind](spark, at, name)
