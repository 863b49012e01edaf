"""Workspace sources on small texts."""

import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.operators import findings, graph
from tessera.sources import workspace as W


def test_module_files_follow_declarations(spark):
    files = {
        "r/lib.rs": "// mod no;\nmod a;\npub(crate) mod b;\n#[path = \"odd/x.rs\"]\nmod c;\nmod gone;\n", "r/a.rs": "mod deep;", "r/a/deep.rs": "mod deep;", "r/b/mod.rs": "#[cfg(test)]\nmod t;", "r/b/t.rs": "", "r/odd/x.rs": "", "r/no.rs": "", "r/a/deep/deep.rs": "",
    }
    got = W.module_files(spark.createDataFrame(list(files.items()), "path string, content string"), spark.createDataFrame([("r/lib.rs",)], "root string"))
    assert sorted(r.path for r in got.collect()) == ["r/a.rs", "r/a/deep.rs", "r/a/deep/deep.rs", "r/b/mod.rs", "r/b/t.rs", "r/lib.rs", "r/odd/x.rs"]


def test_includes_lines_regions_and_macros(spark):
    src = 'include!("gen.rs");\ninclude!(concat!(env!("OUT_DIR"), "/x.rs"));\ninclude!(concat!(env!("NO"), "/y.rs"));\n'
    f = spark.createDataFrame([("s/a.rs", src)], "path string, content string")
    assert sorted(r.target for r in W.included_files(f, {"OUT_DIR": "/out"}).collect()) == ["/out/x.rs", "s/gen.rs"]
    code = 'let a = "/* no */"; // c\n\n/* x\n y */ let b;\n/* z */\n// w'
    kinds = W.line_kinds(spark.createDataFrame([("a", code)], "path string, content string")).orderBy("line").collect()
    assert [r.kind for r in kinds] == ["code", "blank", "comment", "code", "comment", "comment"]
    gated = 'é\n#[cfg(all(unix, feature = "x"))]\nfn f() { g(); }\n#[cfg(test)]\nmod t;\n'
    got = W.gated_regions(spark.createDataFrame([("a", gated)], "path string, content string")).collect()
    raw = gated.encode()
    assert [(raw[r.lo : r.hi].decode().split("\n")[-1], r.predicate) for r in got] == [("fn f() { g(); }", 'all(unix, feature = "x")'), ("mod t;", "test")]
    m = W.macro_directives(spark.createDataFrame([("a", "x\n  tessera_lint::expect!(unused_pub, file_size);\n")], "path string, content string"))
    assert sorted((r.line, r.kind, r.lint) for r in m.collect()) == [(2, "expect", "file-size"), (2, "expect", "unused-pub")]


def test_settings_are_audited(spark):
    text = '[lints]\ndefault = "warn"\nunused-pb = "deny"\n[file-size]\nrulez = 1\n[[file-size.rules]]\nglob = "x"\nmax-lines = 3\n[crates.core.unused-pub]\nkind = []\n[crates.cor.lints]\nunused-pub = "allow"\n[crates.core]\nexpand = 1\n[nosuch]\na = 1\n'
    got = W.unknown_keys(W.settings_rows(spark, text), W.allowed_keys(spark, ["unused-pub", "file-size"]), spark.createDataFrame([("core",)], "member string"))
    want = {("lints", "unused-pb", "unused-pub"), ("file-size", "rulez", "rules"), ("file-size.rules", "max-lines", None), ("crates.core.unused-pub", "kind", "kinds"), ("crates", "cor", "core"), ("crates.core", "expand", None), ("", "nosuch", None)}
    assert {tuple(r) for r in got.collect()} == want
    assert W.load_settings("[a]\nx = 1\n[crates.k.a]\ny = 2\n")["crates"]["k"]["a"] == {"y": 2}
    assert W.primary_after_scoped([{"target": "t"}, {}]) and not W.primary_after_scoped([{}, {"target": "t"}])
    assert len(W.unique_configs([{"features": ["a", "b"]}, {"features": ["b", "a"]}, {"features": []}])) == 2


def test_fragments_baseline_states_and_commands(spark, tmp_path):
    frag = spark.createDataFrame([("u", "k", ["w/k/a.rs", "w/other/b.rs", "w/k/a.rs"], [("p", 1), ("q", 2)])], "unit_id string, crate_name string, loaded_files array<string>, items array<struct<path:string,key:int>>")
    assert [(r.ord, r.path, r.key) for r in W.child_rows(frag, "items").collect()] == [(0, "p", 1), (1, "q", 2)]
    assert [r.value for r in W.loaded_files(frag, spark.createDataFrame([("k", "w/k")], "crate_name string, dir string")).collect()] == ["w/k/a.rs"]
    e = spark.createDataFrame([("u", "a", "b", 1, "f", 9), ("u", "a", "b", 1, "f", 3), ("u", "a", "c", 2, "f", 1)], "unit_id string, from_path string, to_path string, to_key int, file string, lo int")
    assert sorted(r.lo for r in W.deduplicated(e).collect()) == [1, 3]
    spark.createDataFrame([("f", 5, 2), ("f", 5, 3)], "fp string, n_tokens int, n_instances int").write.json(f"{tmp_path}/twice")
    with pytest.raises(ValueError, match="twice"):
        W.read_baseline(spark, f"{tmp_path}/twice")
    d = tmp_path / "repo"
    d.mkdir()
    for n in ("a", "b"):
        (d / n).write_text("x")
    for a in (["init", "-q"], ["add", "a", "b"], ["-c", "user.name=x", "-c", "user.email=x@y", "commit", "-qm", "m"]):
        subprocess.run(["git", "-C", str(d), *a], check=True)
    (d / "b").write_text("y")
    (d / "c").write_text("z")
    assert {r.path: r.state for r in W.file_states(spark, str(d)).collect()} == {"a": "clean", "b": "dirty"}
    assert W.file_states(spark, str(tmp_path)).count() == 0
    f = spark.createDataFrame([("p", "x <a>old<b>")], "path string, content string")
    assert W.expanded(f, "<a>", "<b>", ["printf", "new"]).first().content == "x <a>new<b>" and W.expanded(f, "<a>", "<b>", ["false"]).first().content == "x <a>old<b>"
    have, want = [spark.createDataFrame([(1,)], "id int")], spark.createDataFrame([(1,), (2,)], "id int")
    assert W.complete(lambda: have[0], want, ["id"], lambda lost: have.__setitem__(0, want)).count() == 2
    with pytest.raises(ValueError, match="unknown source"):
        W.provide(spark, "nosuch", "", "")


def test_renderers(spark):
    f = spark.createDataFrame([(1, "x", "warning", "m", "a\\b.rs", 3, ["h"], ["n"], True), (2, "x", "error", "k", None, None, [], ["n"], True)], "pos int, lint string, level string, message string, file string, line int, helps array<string>, notes array<string>, once boolean")
    got = [r.value for r in findings.render(f, "human").orderBy("pos").collect()]
    assert got == ["warning: m\n --> a/b.rs:3\n  |\n  = help: h\n  = note: n", "error: k"]
    assert '"children":[{"level":"help","message":"h"},{"level":"note","message":"n"}]' in findings.render(f, "json").first().value
    r = spark.createDataFrame([("f", 1, 5, "a"), ("f", 5, 9, "b"), ("f", 20, 21, "c")], "file string, lo int, hi int, tag string")
    merged = graph.coalesce_ranges(r, ["file"], merge={"tags": F.sort_array(F.collect_set("tag"))}).orderBy("lo").collect()
    assert [(x.lo, x.hi, x.tags) for x in merged] == [(1, 9, ["a", "b"]), (20, 21, ["c"])]
