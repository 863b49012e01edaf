"""Clone groups: normalise, fingerprint, gate, bucket, subsume; divergence, ratchet and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import dealt

# Gates of the clone query.
MIN_LINES, MIN_TOKENS, MIN_INSTANCES, MIN_ANCHORS, MIN_RATIO, MAX_PARAMS, MAX_LIVE_OUT, WINDOW = 8, 40, 2, 4, 0.5, 3, 1, 8
TOKEN = "[A-Za-z_][A-Za-z_0-9]*|[0-9]+(?:\\.[0-9]+)?|\"[^\"]*\"|[^\\sA-Za-z_0-9]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def normalised(text: Column, binds: Column | None = None, ignore_literals: bool = True) -> Column:
    """Tokens with literals as kinds and bound names as #n in order of first occurrence."""
    t = tokens(text)
    if ignore_literals:
        t = F.transform(t, lambda x: F.when(x.rlike('^"'), "$str").when(x.rlike("^[0-9]+\\."), "$float").when(x.rlike("^[0-9]"), "$int").otherwise(x))
    if binds is not None:
        seen = F.array_distinct(F.filter(t, lambda x: F.array_contains(binds, x)))
        t = F.transform(t, lambda x: F.when(F.array_contains(seen, x), F.concat(F.lit("#"), F.array_position(seen, x).cast("string"))).otherwise(x))
    return t


def fingerprint(stream: Column) -> Column:
    return F.md5(F.array_join(stream, "\x1f"))


def non_repeating_ratio(stream: Column, width: int = WINDOW) -> Column:
    """1 - repeats / windows of `width` tokens; 1.0 without a window."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(stream) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(stream, i, width), "\x1f"))
    n = F.size(stream) - width + 1
    return F.when(n < 1, F.lit(1.0)).otherwise(F.size(F.array_distinct(windows)) / n)


def gated(regions: DataFrame, min_tokens: int = MIN_TOKENS, min_anchors: int = MIN_ANCHORS, min_ratio: float = MIN_RATIO) -> DataFrame:
    return regions.where((F.col("n_tokens") >= min_tokens) & (F.col("anchors") >= min_anchors) & (F.col("ratio") >= min_ratio))


def clone_groups(regions: DataFrame, min_instances: int = MIN_INSTANCES, cross_crate: bool = False) -> DataFrame:
    """(fp, n_tokens, n_instances, instances): buckets of regions(fp, n_tokens, file, crate, line, end_line)."""
    g = regions.groupBy("fp", "n_tokens").agg(
        F.count("*").alias("n_instances"), F.count_distinct("crate").alias("n_crates"), F.sort_array(F.collect_list(F.struct("file", "line", "end_line"))).alias("instances")
    )
    ok = (F.col("n_instances") >= min_instances) & ((F.col("n_crates") >= 2) if cross_crate else F.lit(True))
    return g.where(ok)


def subsume(groups: DataFrame, width: int = 256) -> DataFrame:
    """Greedy, largest first: a group goes if every instance lies within an accepted one of the same file.

    Which larger groups hold an instance comes from one join, lines being dealt to cells. A group is decided once those that
    could hold it are: rounds go down the nesting, each over all groups, and no set of files is gathered in one task.
    """
    from .graph import cut

    rank = F.struct((-F.col("n_tokens")).alias("t"), F.col("instances")[0]["file"].alias("f"), F.col("instances")[0]["line"].alias("l"), "fp")
    g = cut(groups.select("fp", "n_tokens", rank.alias("rank"), F.posexplode("instances").alias("k", "i")).select("fp", "n_tokens", "rank", "k", "i.file", "i.line", "i.end_line"))
    cell = lambda c: F.floor(F.col(c) / width)
    outer = g.select("file", F.col("line").alias("lo"), F.col("end_line").alias("hi"), F.col("rank").alias("by"), F.explode(F.sequence(cell("line"), cell("end_line"))).alias("c"))
    held = g.withColumn("c", cell("line")).join(outer, ["file", "c"]).where("lo <= line and end_line <= hi and by < rank").select("rank", "k", "by").distinct()
    held = cut(g.select("rank", "k").distinct().join(held, ["rank", "k"], "left"))
    done = None
    todo = held
    while not todo.isEmpty():
        known = todo.withColumn("ok", F.lit(None).cast("boolean")) if done is None else todo.join(done.select(F.col("rank").alias("by"), "ok"), "by", "left")
        inst = known.groupBy("rank", "k").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("inside"), F.bool_and(F.col("by").isNull() | F.col("ok").isNotNull()).alias("sure"))
        by = inst.groupBy("rank").agg(F.bool_and("inside").alias("drop"), F.bool_or(F.col("sure") & ~F.col("inside")).alias("keep"))
        new = by.where("drop or keep").select("rank", F.col("keep").alias("ok"))
        done = cut(new if done is None else done.unionByName(new))
        todo = cut(todo.join(done.select("rank"), "rank", "left_anti"))
    kept = g.limit(0).select("rank") if done is None else done.where("ok").select("rank")
    return groups.join(g.join(kept, "rank", "left_semi").select("fp", "n_tokens").distinct(), ["fp", "n_tokens"], "left_semi")


def divergence(literals: DataFrame) -> DataFrame:
    """(gid, values, support, divergent): positions of a group that vary together form one class.

    literals(gid, instance, pos, text): each position's column of texts in instance order.
    """
    column = literals.groupBy("gid", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("instance", "text"))), lambda x: x["text"]).alias("values"))
    return column.groupBy("gid", "values").agg(F.count("*").alias("support"), F.min("pos").alias("first_pos")).withColumn("divergent", F.size(F.array_distinct("values")) > 1)


def divergence_stats(classes: DataFrame) -> DataFrame:
    """(gid, positions, divergent, params): literal positions of a group, those that differ, and the parameters they'd take."""
    return classes.groupBy("gid").agg(F.sum("support").alias("positions"), F.sum(F.when(F.col("divergent"), F.col("support")).otherwise(0)).alias("divergent"), F.count_if("divergent").alias("params"))


def violations(classes: DataFrame) -> DataFrame:
    """(gid, pos, instance, found, expected): lone positions one literal away from a class of two or more that differs: likely forgotten edits.

    The donor is the class with the most positions, the last such one. The odd literal must be what another instance of the donor has,
    and neither it nor the expected one a sentinel.
    """
    from ..functions.paths import diff_count, is_sentinel

    d = classes.where("support = 1").select("gid", F.col("values").alias("defector"), F.col("first_pos").alias("pos"))
    donor = classes.where("divergent and support >= 2").select("gid", F.col("values").alias("donor"), "support", F.col("first_pos").alias("dp"))
    near = d.join(donor, "gid").where(diff_count(F.col("defector"), F.col("donor")) == 1)
    best = near.groupBy("gid", "pos", "defector").agg(F.max_by("donor", F.struct("support", "dp")).alias("donor"))
    at = F.expr("array_position(zip_with(defector, donor, (a, b) -> a <> b), true)").cast("int")
    v = best.withColumn("at", at).withColumn("found", F.element_at("defector", F.col("at"))).withColumn("expected", F.element_at("donor", F.col("at")))
    twin = F.expr("exists(filter(donor, (x, j) -> j + 1 <> at), x -> x = found)")
    return v.where(twin & ~is_sentinel(F.col("found")) & ~is_sentinel(F.col("expected"))).select("gid", "pos", (F.col("at") - 1).alias("instance"), "found", "expected")


def survives_gate(n_violations: Column, n_params: Column, most: int = MAX_PARAMS) -> Column:
    return ~((n_violations == 0) & F.lit(most > 0) & (n_params > most))


def ratchet(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(fp, n_tokens, verdict): new, grew, covered, overcount or orphan against the recorded groups."""
    c = current.select("fp", "n_tokens", F.col("n_instances").alias("now"))
    b = baseline.select("fp", "n_tokens", F.col("n_instances").alias("was"))
    v = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "orphan").when(F.col("now") > F.col("was"), "grew").when(F.col("now") < F.col("was"), "overcount").otherwise("covered")
    return c.join(b, ["fp", "n_tokens"], "full").select("fp", "n_tokens", v.alias("verdict"))


def duplicate_records(baseline: DataFrame) -> DataFrame:
    return baseline.groupBy("fp", "n_tokens").count().where("count > 1")


def stitchable(groups: DataFrame, most: int = 5, width: int = 64) -> DataFrame:
    """Pairs of groups of equal size whose instances lie near each other pair by pair, counted for each largest gap up to `most` (cumulative).

    A gap is the later start less the earlier end, 0 where two overlap, and the largest of a pair counts; pairs of gap 0 don't. Groups
    at the same places are counted first and compared once; the rest meet by all of their files and cells of lines, each pair in the
    first cell that both have.
    """
    place = F.transform("instances", lambda x: F.struct(x["file"], x["line"], x["end_line"]))
    g = groups.select(place.alias("i")).where(F.forall("i", lambda x: x["file"].isNotNull())).groupBy("i").agg(F.count("*").alias("n"))
    g = g.withColumn("files", F.transform("i", lambda x: x["file"]))
    line, end = F.col("i")[0]["line"], F.col("i")[0]["end_line"]

    def celled(x: str, more: int) -> DataFrame:
        lo, hi = F.floor(F.least(line - more, end + more) / width), F.floor(F.greatest(line - more, end + more) / width)
        return g.select("files", F.col("i").alias(f"i{x}"), F.col("n").alias(f"n{x}"), lo.alias(f"c{x}"), F.explode(F.sequence(lo, hi)).alias("c"))

    gap = lambda x, y: F.greatest(y["line"] - x["end_line"], x["line"] - y["end_line"], F.lit(0))
    top = lambda a, b: F.array_max(F.zip_with(a, b, gap)).alias("gap")
    pair = celled("a", most).join(celled("b", 0), ["files", "c"]).where("ia < ib and c = greatest(ca, cb)").select(top("ia", "ib"), (F.col("na") * F.col("nb")).alias("n"))
    same = g.where("n > 1").where(line.isNotNull() & end.isNotNull()).select(top("i", "i"), F.expr("n * (n - 1) div 2").alias("n"))
    near = pair.unionByName(same).where(F.col("gap").between(1, most))
    return near.select(*[F.coalesce(F.sum(F.when(F.col("gap") <= x, F.col("n"))), F.lit(0)).alias(f"gap_{x}") for x in range(1, most + 1)])


def measures(groups: DataFrame, stats: DataFrame, found: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """One row a group without judging: anchor, instances, tokens, lines, literal positions, parameters, drift, class."""
    first = F.col("instances")[0]
    m = groups.select("gid", "fp", "n_tokens", F.size("instances").alias("n_instances"), first["file"].alias("file"), first["line"].alias("line"), (first["end_line"] - first["line"] + 1).alias("n_lines"))
    drift = found.groupBy("gid").agg(F.count("*").alias("drift"))
    m = m.join(stats, "gid", "left").join(drift, "gid", "left").withColumn("drift", F.when(F.col("positions").isNotNull(), F.coalesce("drift", F.lit(0))))
    return m if classes is None else m.join(classes.select("gid", F.col("refactoring").alias("class")), "gid", "left")


def stats_readout(measured: DataFrame, thresholds: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """(what, value, n): histogram of parameters, groups without any, groups a limit of parameters would hide, drift candidates."""
    d = measured.where("positions is not null")
    out = d.groupBy(F.col("params").cast("int").alias("value")).agg(F.count("*").alias("n")).select(F.lit("params").alias("what"), "value", "n")
    none = F.lit(None).cast("int").alias("value")
    out = out.unionByName(d.agg(F.count_if(F.col("params") == 0).alias("n")).select(F.lit("identical").alias("what"), none, "n"))
    for k in thresholds:
        out = out.unionByName(d.agg(F.count_if((F.col("drift") == 0) & (F.col("params") > k)).alias("n")).select(F.lit("suppressed").alias("what"), F.lit(k).alias("value"), "n"))
    return out.unionByName(d.agg(F.coalesce(F.sum("drift"), F.lit(0)).alias("n")).select(F.lit("drift").alias("what"), none, "n"))


def scan_files(files: DataFrame, include: list[str], exclude: list[str], ignore_tests: bool = True) -> DataFrame:
    """Files to scan, each once: of wanted targets, included (if any pattern) and not excluded. files(path, real_path, target_kind)."""
    from ..functions.paths import any_glob

    f = files.where(~F.col("target_kind").isin("test", "bench", "example")) if ignore_tests else files
    f = f.withColumn("_n", F.row_number().over(Window.partitionBy("real_path").orderBy("path", "target_kind"))).where("_n = 1").drop("_n")
    return f.where((any_glob(F.col("path"), include) if include else F.lit(True)) & ~any_glob(F.col("path"), exclude))


def statement_runs(statements: DataFrame, longest: int | None = None) -> DataFrame:
    """Runs of two statements or more of a block: (block, first, last, tokens). statements(block, pos, tokens)."""
    statements = dealt(statements, "block", rows=100_000)
    w = Window.partitionBy("block").orderBy("pos").rowsBetween(0, longest - 1 if longest else Window.unboundedFollowing)
    runs = statements.withColumn("r", F.collect_list(F.struct("pos", "tokens")).over(w))
    each = runs.select("block", F.col("pos").alias("first"), F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("r"), F.lit(2))), lambda n: F.slice("r", 1, n))).alias("s"))
    return each.where("size(s) > 1").select("block", "first", F.element_at("s", -1)["pos"].alias("last"), F.flatten(F.transform("s", lambda x: x["tokens"])).alias("tokens")).distinct()


def refactoring_class(members: DataFrame, traits: DataFrame, types: DataFrame, macros: list[str], max_params: int = MAX_PARAMS) -> DataFrame:
    """(gid, refactoring) by precedence: trait method, merge, component, receiver method, none.

    members(gid, fn, method, trait, first_type, callees array, macros array, dead).
    """
    g = members.groupBy("gid").agg(
        F.count("*").alias("n"), F.count_distinct("trait").alias("nt"), F.min("trait").alias("trait"), F.count_distinct("method").alias("nm"), F.bool_and(F.col("trait").isNotNull()).alias("all_t"),
        F.count_distinct("first_type").alias("ny"), F.min("first_type").alias("ty"), F.bool_and(F.col("first_type").isNotNull()).alias("all_y"),
        F.count_distinct(F.array_join(F.sort_array("callees"), ",")).alias("nc"), F.count_if("dead").alias("dead"),
        F.array_sort(F.array_intersect(F.flatten(F.collect_list("macros")), F.array(*[F.lit(x) for x in macros]).cast("array<string>"))).alias("ui"),
    )
    g = g.join(traits.select(F.col("name").alias("trait"), F.lit(True).alias("_t")).distinct(), "trait", "left").join(types.select(F.col("name").alias("ty"), F.lit(True).alias("_y")).distinct(), "ty", "left")
    c = (
        F.when(F.col("all_t") & (F.col("nt") == 1) & (F.col("nm") == 1) & F.col("_t").isNotNull(), "default-trait-method").when(F.col("nc") == 1, "merge-family")
        .when(F.size("ui") > 0, "ui-component").when(F.col("all_y") & (F.col("ny") == 1) & F.col("_y").isNotNull(), "receiver-method").otherwise("unclassified")
    )
    return g.select("gid", c.alias("refactoring"), ((F.col("dead") > 0) & (F.col("dead") < F.col("n"))).alias("has_dead_copies"))
