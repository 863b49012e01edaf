"""Findings: levels, suppression, stale expectations, unknown names, renderers and edits.

finding(lint, level, explicit, message, scope, file, line, crate); scope: line, file, crate or workspace.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P

LOOK_AHEAD = 3  # fixed value: lines below a directive that it still governs


def apply_levels(findings: DataFrame, levels: DataFrame) -> DataFrame:
    """Relabel by levels(lint, level); explicit levels stay; `allow` drops the finding."""
    j = findings.join(levels.select("lint", F.col("level").alias("_l")), "lint", "left")
    level = F.when(F.col("explicit"), F.col("level")).otherwise(F.coalesce("_l", "level"))
    return j.withColumn("level", level).where("level <> 'allow'").select(*findings.columns)


def suppressed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """(finding id, directive id) pairs that match: same scope or a wider one, or up to LOOK_AHEAD lines above.

    Equi joins by lint, scope and a file's name; then paths are compared by suffix, since some are relative. findings need
    `fid`; directives(did, lint, scope, file, line, crate).
    """
    base = lambda d: d.withColumn("_b", F.substring_index("file", "/", -1))
    f = base(findings.select("fid", "lint", "file", F.col("line").alias("fl"), "crate"))
    d = base(directives).withColumnRenamed("file", "df")
    near = lambda j: j.where(P.same_file(F.col("file"), F.col("df")))
    ahead = d.where("scope = 'line'").withColumn("fl", F.explode(F.sequence("line", F.col("line") + LOOK_AHEAD))).select("did", "lint", "df", "_b", "fl")
    by_line = near(f.join(ahead, ["lint", "_b", "fl"]))
    by_file = near(f.join(d.where("scope = 'file'").select("did", "lint", "df", "_b"), ["lint", "_b"]))
    by_crate = f.join(directives.where("scope = 'crate'").select("did", "lint", "crate"), ["lint", "crate"])
    everywhere = f.join(directives.where("scope = 'workspace'").select("did", "lint"), ["lint"])
    out = [x.select("fid", "did") for x in (by_line, by_file, by_crate, everywhere)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).distinct()


def suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    return findings.join(suppressed(findings, directives).select("fid").distinct(), "fid", "left_anti")


def stale_expects(findings: DataFrame, directives: DataFrame, ran: DataFrame) -> DataFrame:
    """(file, line, stale, deletable): expectations without a match, by source line.

    Only `expect` entries count, and of these only lints that ran (ran holds known lints alone) are judged; equal lints of a line
    are one, met if any of them is. A line can go only if each of its lints was judged and unmet.
    """
    met = suppressed(findings, directives).select("did").distinct().withColumn("_m", F.lit(True))
    d = directives.where("kind = 'expect'").join(met, "did", "left").join(ran.select("lint", F.lit(True).alias("_r")).distinct(), "lint", "left")
    each = d.groupBy("file", "line", "lint").agg(F.bool_or(F.coalesce("_m", F.lit(False))).alias("met"), F.bool_or(F.coalesce("_r", F.lit(False))).alias("judged"))
    stale = F.col("judged") & ~F.col("met")
    g = each.groupBy("file", "line").agg(F.sort_array(F.collect_set(F.when(stale, F.col("lint")))).alias("stale"), F.bool_and(stale).alias("deletable"))
    return g.where(F.size("stale") > 0)


def unknown(names: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Names outside the vocabulary, each with the nearest known name within three edits."""
    odd = names.join(known.select(name), name, "left_anti")
    near = closest(odd.select(F.col(name).alias("target")), known.select(F.col(name).alias("n"))).withColumnRenamed("target", name)
    return odd.join(near, name, "left")


def closest(targets: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(target, suggestion): the first name with the smallest edit distance, for targets with one within `most`.

    A name is cut in `most` + 1 pieces. Within `most` edits one piece stands whole in the target, at most `most`
    places from its own, so targets and names of close lengths meet in an equi join on pieces.
    """
    k = most + 1
    cut = lambda size, i: F.floor(size * i / k).cast("int")
    piece = lambda text, size, i, at: F.substring(text, at + 1, cut(size, i + 1) - cut(size, i))
    own = names.where("n is not null").distinct().withColumn("size", F.length("n")).withColumn("i", F.explode(F.array(*map(F.lit, range(k)))))
    own = own.select("n", "size", "i", piece(F.col("n"), F.col("size"), F.col("i"), cut(F.col("size"), F.col("i"))).alias("piece"))
    by = targets.where("target is not null").distinct().withColumn("l", F.length("target"))
    by = by.withColumn("size", F.explode(F.sequence(F.greatest(F.col("l") - most, F.lit(0)), F.col("l") + most))).withColumn("i", F.explode(F.array(*map(F.lit, range(k)))))
    start = cut(F.col("size"), F.col("i"))
    by = by.withColumn("at", F.explode(F.sequence(F.greatest(start - most, F.lit(0)), start + most)))
    by = by.select("target", "size", "i", piece(F.col("target"), F.col("size"), F.col("i"), F.col("at")).alias("piece")).distinct()
    d = F.levenshtein("target", "n")
    return by.join(own, ["size", "i", "piece"]).select("target", "n").distinct().withColumn("d", d).where(F.col("d") <= most).groupBy("target").agg(F.min(F.struct("d", "n"))["n"].alias("suggestion"))


def owning_crate(anchors: DataFrame, crates: DataFrame) -> DataFrame:
    """anchors with the crate of the longest directory above their file. anchors(fid, file); crates(crate, dir)."""
    parts = F.split("file", "/")
    up = anchors.select("fid", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("n", "dir"))
    best = up.join(crates, "dir").groupBy("fid").agg(F.max_by("crate", "n").alias("owner"))
    return anchors.join(best, "fid", "left")


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level").agg(F.count("*").alias("n"))


def once_notes(notes: DataFrame, order: str = "pos") -> DataFrame:
    """Each (lint, note) only where it comes first."""
    w = Window.partitionBy("lint", "note").orderBy(order)
    return notes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def render_github(findings: DataFrame) -> DataFrame:
    """Workflow commands, one line each. findings(level, lint, message, file, line, col, scope, anchor_file, anchor_line, manifest_dir).

    A finding without a place of its own takes its anchor's: a line, a file, the crate's manifest or the workspace's.
    """
    own, one = F.col("file").isNotNull(), F.lit(1)
    scope = F.col("scope")
    file = F.when(own, F.col("file")).when(scope.isin("line", "file"), F.col("anchor_file")).when(scope == "crate", F.concat("manifest_dir", F.lit("/Cargo.toml"))).otherwise("Cargo.toml")
    line = F.when(own, F.col("line")).when(scope == "line", F.col("anchor_line")).otherwise(one)
    col = F.when(own, F.col("col")).otherwise(one)
    text = [F.lit("::"), F.col("level"), F.lit(" file="), P.escape_property(P.display_path(file)), F.lit(",line="), line.cast("string"), F.lit(",col="), col.cast("string")]
    return findings.select(F.concat(*text, F.lit(",title="), P.escape_property(F.col("lint")), F.lit("::"), P.escape_data(F.col("message"))).alias("value"))


def render(findings: DataFrame, form: str) -> DataFrame:
    """Findings in one of the formats: human, json or github."""
    return {"human": render_human, "json": render_json, "github": render_github}[form](findings)


def rule_note(lint: str, glob: Column) -> Column:
    """Which rule a finding comes from."""
    return F.concat(F.lit(f"configured by the `{lint}` rule with glob `"), glob, F.lit("`"))


def drop_generated(findings: DataFrame, generated: DataFrame) -> DataFrame:
    """Findings that are not anchored in a generated file; those without a file stay. generated(path)."""
    key = lambda c: P.display_path(F.col(c))
    return findings.withColumn("_p", key("file")).join(generated.select(key("path").alias("_p")).distinct(), "_p", "left_anti").drop("_p")


def needed_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits that change something: the bytes in their range are not the replacement yet. files(path, content); edits(path, lo, hi, replacement)."""
    j = edits.join(files.select("path", F.encode("content", "utf-8").alias("_b")), "path")
    fits = (F.col("lo") < F.octet_length("_b")) & (F.col("hi") <= F.octet_length("_b")) & (F.col("lo") <= F.col("hi"))
    now = F.decode(F.substring(F.col("_b"), F.col("lo") + 1, F.col("hi") - F.col("lo")), "utf-8")
    return j.where(~(fits & (now == F.col("replacement")))).select(*edits.columns)


def tracked_edits(edits: DataFrame, tracked: DataFrame) -> DataFrame:
    """Edits of files under version control; an empty table of tracked files (no repository) withholds none. tracked(path)."""
    some = tracked.limit(1).select(F.lit(True).alias("_s"))
    j = edits.join(F.broadcast(some), how="left").join(tracked.select("path", F.lit(True).alias("_t")).distinct(), "path", "left")
    return j.where("_s is null or _t").select(*edits.columns)


def render_json(findings: DataFrame) -> DataFrame:
    """One JSON object a finding: level, message, code, spans and children (helps, then notes). helps and notes are arrays of texts."""
    span = F.struct(F.col("file").alias("file_name"), F.col("line").alias("line_start"), F.lit(True).alias("is_primary"))
    spans = F.filter(F.array(F.when(F.col("file").isNotNull(), span)), lambda x: x.isNotNull())
    child = lambda kind, c: F.transform(c, lambda m: F.struct(F.lit(kind).alias("level"), m.alias("message")))
    children = F.concat(child("help", "helps"), child("note", "notes"))
    return findings.select(F.to_json(F.struct("level", "message", F.struct(F.col("lint").alias("code")).alias("code"), spans.alias("spans"), children.alias("children"))).alias("value"))


def render_human(findings: DataFrame) -> DataFrame:
    """`level: message`, the place, helps, and notes; a note that is said once (`once`) only where it comes first. findings also have pos, helps, notes, once."""
    w = Window.partitionBy("lint", "note").orderBy("pos")
    each = findings.select("pos", "lint", "once", F.posexplode("notes").alias("k", "note")).withColumn("n", F.row_number().over(w)).where("not once or n = 1")
    said = each.groupBy("pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "note"))), lambda x: x["note"]).alias("said"))
    j = findings.join(said, "pos", "left")
    lines = lambda kind, c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"\n  = {kind}: "), x)), "")
    place = F.when(F.col("file").isNotNull(), F.concat(F.lit("\n --> "), P.display_path(F.col("file")), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.lit("\n  |"))).otherwise("")
    return j.select("pos", F.concat("level", F.lit(": "), "message", place, lines("help", F.col("helps")), lines("note", F.col("said"))).alias("value"))


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, applied): byte-range replacements, last first. files(path, content); edits(path, lo, hi, replacement).

    Deletions are unioned; a file with overlapping rewrites, or ranges outside it, is left as it is.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.content.iloc[0].encode()
        rows = pdf.dropna(subset=["lo"])
        cuts: list[list] = []
        for lo, hi in sorted((int(r.lo), int(r.hi)) for r in rows.itertuples() if r.replacement == ""):
            if cuts and lo <= cuts[-1][1]:
                cuts[-1][1] = max(cuts[-1][1], hi)
            else:
                cuts.append([lo, hi])
        todo = sorted([(a, b, b"") for a, b in cuts] + list({(int(r.lo), int(r.hi), r.replacement.encode()) for r in rows.itertuples() if r.replacement}))
        fits = all(a[1] <= b[0] for a, b in zip(todo, todo[1:], strict=False)) and all(0 <= a <= b <= len(data) for a, b, _ in todo)
        new = data
        for lo, hi, text in reversed(todo) if fits else ():
            new = new[:lo] + text + new[hi:]
        return pd.DataFrame({"path": [pdf.path.iloc[0]], "content": [new.decode()], "applied": [bool(fits and new != data)]})

    j = files.select("path", "content").join(edits.select("path", "lo", "hi", "replacement"), "path", "left")
    return j.groupBy("path").applyInPandas(one, "path string, content string, applied boolean")
