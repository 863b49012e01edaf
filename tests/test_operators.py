"""Rules that the driver's tables can't show, on small fact tables."""

import random

from pyspark.sql import functions as F

from tessera import sources
from tessera.functions import paths as P
from tessera.functions import text
from tessera.operators import clones, findings, graph, imports, scaffold, usage, verdicts
from tessera.plans import registry


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_scalars(spark):
    a = F.array(*map(F.lit, ("a", "b", "c")))
    r = one(
        spark, P.canonical_prefixes(a), P.canonical_prefixes(F.array(F.lit("a"))), P.camel_words(F.lit("HTTPServerName2")), P.is_sentinel(F.lit("0u8")), P.is_sentinel(F.lit("12")),
        P.escape_property(F.lit("a:b,c%\n")), P.traits_match(F.lit("a::T"), F.lit("b::T")), P.extract_version(F.lit("\x1b[1mtool 1.2.3\x1b[0m"), "(\\d+\\.\\d+\\.\\d+)"), P.word_match(F.lit("a foo_b foo"), F.lit("foo")),
        P.word_match(F.lit("foo_b"), F.lit("foo")), P.feature_dependency(F.lit("x?/y")), P.capped_list(a, 2), P.type_base(F.lit("&'a mut std::vec::Vec<T>")),
    )
    assert r.c0 == [["a", "b"], ["a", "b", "c"]] and r.c1 == []
    assert r.c2 == ["HTTP", "Server", "Name2"]
    assert (r.c3, r.c4) == (True, False)
    assert r.c5 == "a%3Ab%2Cc%25%0A" and r.c6 and r.c7 == "1.2.3" and r.c8 and not r.c9
    assert (r.c10, r.c11, r.c12) == ("x", "a, b, and 1 more", "Vec")


def test_kleene_predicates(spark):
    known = {"unix": F.lit(True), "windows": F.lit(False)}
    r = one(spark, P.cfg_predicate(("all", "unix", "feat"), known), P.cfg_predicate(("any", "unix", "feat"), known), P.cfg_predicate(("not", ("all", "windows", "feat")), known))
    assert (r.c0, r.c1, r.c2) == (None, True, True)


def test_fnv1a(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "s string").select(P.fnv1a("s").alias("h"))
    assert [r.h for r in df.collect()] == [0xAF63DC4C8601EC8C - (1 << 64), 0xCBF29CE484222325 - (1 << 64), None]


def test_resolution_legs(spark):
    local = spark.createDataFrame([("k1", "c::m::a"), ("k2", "c::b"), ("k3", "c::x::T::new"), ("k4", "d::x::U"), ("k5", "d::y::U")], "key string, path string")
    index = spark.createDataFrame([("g", "c::b")], "key string, identity string")
    edges = spark.createDataFrame([("k1", "z"), ("g", "z"), ("h", "c::m::a"), ("h", "c::other::T::new"), ("h", "d::U"), ("h", "e::q")], "to_key string, to_path string")
    got = {(r.to_key, r.to_path): r.resolved for r in usage.resolve(edges, local, index).collect()}
    assert got == {("k1", "z"): "k1", ("g", "z"): "k2", ("h", "c::m::a"): "k1", ("h", "c::other::T::new"): "k3", ("h", "d::U"): None, ("h", "e::q"): None}


def test_dep_exemptions(spark):
    decl = spark.createDataFrame(
        [("m", "o", "normal", True, False), ("m", "t", "normal", False, True), ("m", "b", "build", False, False), ("m", "d", "dev", False, False), ("m", "facade", "normal", False, False), ("m", "un-used", "normal", False, False), ("n", "u", "normal", False, False)],
        "member string, name string, kind string, optional boolean, target_gated boolean",
    )
    two = lambda rows, s: spark.createDataFrame(rows, s)
    got = verdicts.dep_verdict(
        decl, two([("m", "inner_lib")], "member string, crate string"), two([], "member string, crate string"), two([("facade", "inner-lib"), ("inner-lib", "facade")], "pkg string, dep string"), two([("m",)], "member string"), two([], "member string")
    )
    assert {r.name: r.verdict for r in got.collect()} == {"o": "optional", "t": "target-gated", "b": "build", "d": "dev-without-tests", "facade": "used", "un-used": "unused", "u": "not-compiled"}


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "src int, dst int")
    got = graph.closure(spark.createDataFrame([(1, 1), (4, 4)], "root int, node int"), e)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (1, 3), (4, 4)]


def test_cascade_veto_is_sticky(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    nodes = spark.createDataFrame([("b",), ("c",), ("d",)], "node string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r["round"] for r in graph.cascade(nodes, e, start).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    stop = graph.cascade(nodes, e, start, veto=lambda n: n.where("node = 'c'"))
    assert {r.node for r in stop.collect()} == {"a", "b"}


def test_subsumption_divergence_and_ratchet(spark):
    groups = spark.createDataFrame(
        [("big", 90, [("f", 1, 30), ("g", 1, 30)]), ("in", 50, [("f", 5, 10), ("g", 5, 10)]), ("out", 50, [("f", 25, 40), ("g", 5, 10)])],
        "fp string, n_tokens int, instances array<struct<file:string,line:int,end_line:int>>",
    )
    assert sorted(r.fp for r in clones.subsume(groups).collect()) == ["big", "out"]
    lits = [(1, i, p, t) for p, col in enumerate((("a", "b", "c"), ("a", "b", "c"), ("a", "b", "a"), ("q", "q", "q"))) for i, t in enumerate(col)]
    classes = clones.divergence(spark.createDataFrame(lits, "gid int, instance int, pos int, text string"))
    assert {tuple(r["values"]): (r.support, r.divergent) for r in classes.collect()} == {("a", "b", "c"): (2, True), ("a", "b", "a"): (1, True), ("q", "q", "q"): (1, False)}
    assert [tuple(r) for r in clones.violations(classes).collect()] == [(1, 2, 2, "a", "c")]
    s = "fp string, n_tokens int, n_instances int"
    got = clones.ratchet(spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", 1, 2)], s), spark.createDataFrame([("b", 1, 2), ("c", 1, 2), ("d", 1, 2)], s))
    assert {r.fp: r.verdict for r in got.collect()} == {"a": "new", "b": "grew", "c": "covered", "d": "orphan"}


def test_normalised_tokens(spark):
    r = one(spark, clones.normalised(F.lit('let x = y + 1; x("s")'), F.array(F.lit("x"), F.lit("y"))), clones.non_repeating_ratio(F.array(F.lit("a"))))
    assert r.c0 == ["let", "#1", "=", "#2", "+", "$int", ";", "#1", "(", "$str", ")"] and r.c1 == 1.0


def test_stitchable_is_cumulative(spark):
    s = "gid int, instances array<struct<file:string,line:int,end_line:int>>"
    g = spark.createDataFrame([(1, [("f", 1, 10), ("f", 41, 50)]), (2, [("f", 12, 20), ("f", 53, 60)])], s)
    assert list(clones.stitchable(g).first()) == [0, 0, 1, 1, 1]
    both_ways = spark.createDataFrame([(1, [("f", 1, 10), ("f", 55, 60)]), (2, [("f", 10, 20), ("f", 41, 50)])], s)
    assert list(clones.stitchable(both_ways).first()) == [0, 0, 0, 0, 1]  # an overlap counts as 0, the later of two may be either
    overlap = spark.createDataFrame([(1, [("f", 1, 10)]), (2, [("f", 5, 20)])], s)
    assert list(clones.stitchable(overlap).first()) == [0, 0, 0, 0, 0]


def test_subsumption_equals_the_greedy_pass(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        at = []
        for _ in range(rng.randrange(2, 4)):
            lo = rng.randrange(1, 700)
            at.append((rng.choice("ab"), lo, lo + rng.randrange(1, 300)))
        rows.append((f"fp{i:03}", rng.randrange(40, 60), sorted(at)))
    kept, want = {}, set()
    for fp, n, inst in sorted(rows, key=lambda r: (-r[1], r[2][0][:2], r[0])):
        if all(any(lo <= a and z <= hi for lo, hi in kept.get(f, ())) for f, a, z in inst):
            continue
        for f, a, z in inst:
            kept.setdefault(f, []).append((a, z))
        want.add(fp)
    df = spark.createDataFrame(rows, "fp string, n_tokens int, instances array<struct<file:string,line:int,end_line:int>>")
    assert {r.fp for r in clones.subsume(df).collect()} == want and len(want) < 120


def test_widened_ranges_and_trimmed_ends(spark):
    src = "a\n  fn x() {}\n \n\nb\n\n\n"
    df = spark.createDataFrame([(src, 4, 13)], "content string, lo int, hi int")
    r = df.select(text.widened("content", "lo", "hi").alias("s"), text.trimmed_end(F.col("content")).alias("t")).first()
    assert (r.s.lo, r.s.hi) == (2, 17) and r.t == "a\n  fn x() {}\n \n\nb\n"


def test_stale_expectations_ignore_allows_and_fold_equal_lints(spark):
    f = spark.createDataFrame([(1, "x", "ws/src/a.rs", 5, "k")], "fid int, lint string, file string, line int, crate string")
    d = "did int, lint string, scope string, file string, line int, crate string, kind string"
    rows = [(1, "x", "line", "src/a.rs", 4, None, "expect"), (2, "y", "line", "src/a.rs", 4, None, "expect"), (3, "z", "line", "src/a.rs", 4, None, "allow"), (4, "y", "line", "src/b.rs", 1, None, "expect"), (5, "q", "line", "src/b.rs", 2, None, "expect"), (6, "z", "line", "src/b.rs", 1, None, "allow")]
    ran = spark.createDataFrame([("x",), ("y",), ("z",)], "lint string")
    got = {(r.file, r.line): (r.stale, r.deletable) for r in findings.stale_expects(f, spark.createDataFrame(rows, d), ran).collect()}
    assert got == {("src/a.rs", 4): (["y"], False), ("src/b.rs", 1): (["y"], True)}


EDGE = "cfg int, crate string, from_path string, from_module string, to_path string, to_kind string, identity string, import boolean, reexport boolean, glob boolean, trait_scope boolean, in_signature boolean, gone boolean, file string, decl_lo int, decl_expansion boolean, elem_lo int, glob_used_names array<string>, receiver_resolved boolean, extern_root boolean, from_expansion boolean"


def edge(src, to, imp=False, glob=False, gone=False, lo=None, used=(), module="c::m", trait=False, known=True, reexport=False):
    return (0, "c", src, module, to, "fn", to if known else None, imp, reexport, glob, trait, False, gone, "f.rs" if lo is not None else None, lo, False, lo, list(used), False, False, False)


def test_dangling_imports(spark):
    rows = [
        edge("c::m", "d::gone", imp=True, lo=1), edge("c::m", "d::kept", imp=True, lo=2), edge("c::m", "d::both", imp=True, lo=3), edge("c::m", "d::re", imp=True, lo=4, reexport=True), edge("c::m", "d::T", imp=True, lo=5),
        edge("c::m::a", "d::kept", gone=True), edge("c::m::a", "d::both", gone=True), edge("c::m::b", "d::both"), edge("c::m::a", "d::re", gone=True), edge("c::m::a", "d::T::new", gone=True),
        edge("c::p", "e::*", imp=True, glob=True, lo=10, used=["E1"], module="c::p"), edge("c::p::x", "e::E1", gone=True, module="c::p"), edge("c::q", "e", imp=True, glob=True, lo=11, used=["E2"], module="c::q"), edge("c::q::x", "e::E2", module="c::q"), edge("c::q::y", "e::E2", gone=True, module="c::q"),
    ]
    e = spark.createDataFrame(rows, EDGE)
    mods = spark.createDataFrame([(0, "c::m"), (0, "c::p"), (0, "c::q")], "cfg int, path string")
    none = spark.createDataFrame([], "path string")
    got = imports.dangling_leaves(e.where("not glob"), mods, spark.createDataFrame([("d::gone",)], "path string"), none)
    assert sorted((r.decl_lo, r.reexport) for r in got.collect()) == [(1, False), (2, False), (5, False)]
    assert [r.decl_lo for r in imports.dangling_globs(e, mods, none).collect()] == [10]


def test_scaffolding_shrinks_to_what_only_serves_targets(spark):
    two = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "path string")
    links = two([("t1", "target"), ("t1", "help"), ("t2", "target2"), ("t2", "shared"), ("other", "shared"), ("t1", "deep"), ("deep", "deeper")])
    items, targets = one("t1", "t2", "help", "shared", "other", "deep", "deeper"), one("target", "target2")
    none = spark.createDataFrame([], "path string")
    universe = scaffold.referrer_closure(links, items, targets, none)
    assert sorted(r.path for r in universe.collect()) == ["deep", "deeper", "help", "shared", "t1", "t2"]
    stay, demoted, blocked = scaffold.shrink_scaffold(links, universe, targets, none, items, none, none)
    assert sorted(r.path for r in stay.collect()) == ["deep", "deeper", "help", "t1", "target"]
    assert {r.path: r.reason for r in demoted.collect()} == {"shared": "kept-by-survivor", "t2": "reaches-survivor"} and [tuple(r) for r in blocked.collect()] == [("target2", "t2")]
    of = scaffold.referrers(links, items, targets)
    cleared = scaffold.cleared_closure(links, of, universe, stay, blocked)
    assert sorted((r.target, r.path) for r in cleared.collect()) == [("target", x) for x in ("deep", "deeper", "help", "t1")]


def test_edits(spark):
    files = spark.createDataFrame([("a", "hello world"), ("b", "xyz"), ("c", "same")], "path string, content string")
    edits = spark.createDataFrame([("a", 0, 3, ""), ("a", 2, 6, ""), ("a", 6, 11, "W"), ("b", 0, 2, "p"), ("b", 1, 3, "q")], "path string, lo int, hi int, replacement string")
    assert {r.path: (r.content, r.applied) for r in findings.apply_edits(files, edits).collect()} == {"a": ("W", True), "b": ("xyz", False), "c": ("same", False)}


def test_levels_and_unknown_names(spark):
    f = spark.createDataFrame([("a", "warn", False), ("b", "warn", True), ("c", "warn", False)], "lint string, level string, explicit boolean")
    lv = spark.createDataFrame([("a", "deny"), ("b", "deny"), ("c", "allow")], "lint string, level string")
    assert {(r.lint, r.level) for r in findings.apply_levels(f, lv).collect()} == {("a", "deny"), ("b", "warn")}
    got = findings.unknown(spark.createDataFrame([("file-sise",), ("zzzzzzzzz",), ("file-size",)], "name string"), spark.createDataFrame([("file-size",), ("crate-size",)], "name string"))
    assert {r.name: r.suggestion for r in got.collect()} == {"file-sise": "file-size", "zzzzzzzzz": None}


def test_sources(spark, tmp_path):
    m = sources.manifest_deps('[dependencies]\na = "1"\nb = { workspace = true, optional = true }\n[target."cfg(unix)".dev-dependencies]\nc = { path = "../c", package = "cc" }\n')
    assert [(x["name"], x["kind"], x["target_gated"]) for x in m] == [("a", "normal", False), ("b", "normal", False), ("cc", "dev", True)]
    assert sources.parse_command("cargo test --features a,b -p x")["features"] == ["a", "b"]
    try:
        sources.parse_command("cargo check --bogus")
    except ValueError as e:
        assert "--bogus" in str(e)
    else:
        raise AssertionError
    f = spark.createDataFrame([("f.rs", "/// ```\n/// dep::run();\n/// ```\n/// no::code\n#[cfg(feature = \"x\")]\n// tessera-lint: expect(a, b)\n")], "path string, content string")
    assert [r.crate for r in sources.doc_fence_refs(f).collect()] == ["dep"]
    assert [(r.line, r.features) for r in sources.cfg_regions(f).collect()] == [(5, ["x"])]
    assert {(r.kind, r.lint, r.line) for r in sources.directives(f).collect()} == {("expect", "a", 6), ("expect", "b", 6)}
    frag = spark.createDataFrame([("c0", 0, "u", 16, "k", "lib", False)], sources.SCHEMAS["fragment"])
    sources.write_facts(frag, str(tmp_path), "fragment")
    assert sources.read_facts(spark, str(tmp_path), "fragment", ["c0"]).count() == 1
    r = one(spark, sources.replace_between(F.lit("x <a>old<b> y"), "<a>", "<b>", "$new"))
    assert r.c0 == "x <a>$new<b> y"


def test_registry():
    @registry.query("demo", "item", requires_config=True)
    def demo(tables):
        return tables["item"]

    assert [q.id for q in registry.enabled({}, {"demo"})] == ["demo"] and registry.enabled({}, set()) == [] and registry.enabled({"demo": "allow"}, {"demo"}) == []
