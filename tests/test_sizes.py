"""What larger tables did to the queries: guessed sizes, keys of many nulls, deep chains, crowded places."""

import random

from oracle import compare

from tessera.operators import clones, graph, model, shadow
from tessera.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_a_kept_table_is_not_planned_by_the_bytes_of_its_files(spark):
    part = graph.cut(spark.read.parquet(f"{SF}/part.parquet").select("p_partkey"))
    assert part.count() == spark.read.parquet(f"{SF}/part.parquet").count()
    assert int(str(part._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 1 << 40
    plan = part.join(part.withColumnRenamed("p_partkey", "k"), part.p_partkey == part.p_partkey)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_removed_edges_of_paths_and_impls(spark):
    rng = random.Random(3)
    paths = ["a", "a::b", "a::b::c", "ab", "d::e"]
    rows = [(rng.choice(paths), rng.choice([0, 1]), rng.choice([None, None, 1, 2]), 5) for _ in range(400)] + [("d::e", 0, None, 5)] * 400
    defs = [(0, 1, "d::e"), (0, 1, "x"), (1, 1, "y"), (0, 2, "a::b"), (1, 2, "z")]
    gone = {"a::b", "z", "nowhere"}
    want = sorted(((p, c, k, t, any(p == r or p.startswith(r + "::") for r in gone) or any((c, k) == d[:2] and d[2] in gone for d in defs)) for p, c, k, t in rows), key=repr)
    e = spark.createDataFrame(rows, "from_path string, cfg int, own_key int, to_key int")
    got = model.edge_removed(e, spark.createDataFrame([(r,) for r in gone] * 2, "path string"), spark.createDataFrame(defs, "cfg int, key int, path string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_rows_without_a_key_are_spread(spark):
    left = graph.cut(spark.range(4000).selectExpr("id % 2 as cfg", "id as key", "CASE WHEN id % 10 = 0 THEN id END AS ref"))
    right = graph.cut(spark.range(0, 4000, 20).selectExpr("0L as cfg", "id as ref", "true as hit"))
    j = model.join_some(left, right.hint("merge"), ["cfg", "ref"], "key")
    assert j.count() == 4000 and j.where("hit").count() == 200
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [n for n in j.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 4000 / 4


def test_dependents_of_a_chain_deeper_than_a_thousand(spark):
    n = 1200
    members = spark.createDataFrame([(f"m-{i}",) for i in range(n)] + [("a-b",), ("a_b",), (None,)], "member string")
    deps = spark.createDataFrame([(f"m-{i}", f"m-{i + 1}") for i in range(n)] + [("a-b", "m-1199"), ("a_b", "m-1198"), ("m-1199", "a_b"), ("gone", "m-3")], "member string, name string")
    got = [tuple(r) for r in shadow.dependents(members, deps).collect()]
    want = {(f"m_{j}", f"m_{i}") for i in range(n) for j in range(i, n)} | {("a_b", f"m_{i}") for i in range(n)} | {("a_b", "a_b"), ("m_1198", "a_b"), ("m_1199", "a_b"), (None, None)}
    want |= {("m_1198", "m_1199")}  # m-1199 needs a_b, which needs m-1198
    assert len(got) == len(set(got)) and set(got) == want


def test_dependents_of_more_links_than_a_task_holds(spark, monkeypatch):
    members = spark.createDataFrame([(f"m-{i}",) for i in range(9)], "member string")
    deps = spark.createDataFrame([(f"m-{i}", f"m-{i * 2 % 9}") for i in range(9)] * 2, "member string, name string")
    want = sorted(map(tuple, shadow.dependents(members, deps).collect()))
    monkeypatch.setattr(shadow, "LINKS", 3)
    assert sorted(map(tuple, shadow.dependents(members, deps).collect())) == want


def stitched(groups, most=5):
    out = [0] * most
    for x, a in enumerate(groups):
        for b in groups[x + 1 :]:
            if len(a) == len(b) and all(p[0] == q[0] for p, q in zip(a, b)):
                gap = max(max(q[1] - p[2], p[1] - q[2], 0) for p, q in zip(a, b))
                out = [n + (1 <= gap <= i) for i, n in enumerate(out, 1)]
    return out


def test_groups_at_the_same_places_are_compared_once(spark):
    rng = random.Random(7)
    one = lambda: (rng.choice("ab"), x := rng.randrange(300), x + rng.choice([0, 5, 90, -2]))
    groups = [sorted(one() for _ in range(rng.choice([1, 2, 2]))) for _ in range(250)] + [[("a", 100, 98)]] * 5
    groups += rng.choices(groups, k=200)
    g = spark.createDataFrame(list(enumerate(groups)), "gid int, instances array<struct<file:string,line:int,end_line:int>>")
    assert list(clones.stitchable(g).first()) == stitched(groups)
    crowd = [(i, [("a", 1, 3)] if i % 2 else [("a", 5, 6)]) for i in range(20_000)]
    found = clones.stitchable(spark.createDataFrame(crowd, "gid int, instances array<struct<file:string,line:int,end_line:int>>"))
    assert list(found.first()) == [0, *[10_000 * 10_000] * 4]


def test_dealt_partitions_follow_the_rows(spark):
    assert graph.dealt(spark.range(1000), "id", rows=100).rdd.getNumPartitions() == 10
    assert graph.dealt(spark.range(3), "id", of=spark.range(1000), rows=300).rdd.getNumPartitions() == 4
    rows = spark.createDataFrame([(i % 50, i, ["x"]) for i in range(200)], "block int, pos int, tokens array<string>")
    assert "REPARTITION_BY_NUM" in clones.statement_runs(rows)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in QUERIES["usage_verdict"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_large_queries_still_equal_sql(spark):
    for name in ("stitchable_pairs", "crate_dependents", "statement_runs"):
        assert compare(spark, name, QUERIES[name], SQL[name], "/root/testdata/sf0.01") > 0


def test_the_fold_is_written_once_for_all_who_read_it(spark):
    assert "is_test_cfg" not in QUERIES["unreached_members"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
