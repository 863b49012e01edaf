"""Queries over lineitem against brute force over all of its rows."""

import pyarrow as pa
import pyarrow.parquet as pq
from oracle import rows

from tessera.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def found(spark, name, d=SF):
    df = QUERIES[name](spark, d)
    return rows(df.columns, df.collect())


def edges():
    orders = {o["o_orderkey"]: o["o_custkey"] for o in table("orders")}
    nation = {c["c_custkey"]: c["c_nationkey"] for c in table("customer")}, {s["s_suppkey"]: s["s_nationkey"] for s in table("supplier")}
    at = [(x, orders[x["l_orderkey"]]) for x in table("lineitem") if x["l_orderkey"] in orders]
    return [(x["l_orderkey"], x["l_suppkey"], nation[0][c] != nation[1][x["l_suppkey"]], x["l_returnflag"] == "R", x["l_linestatus"]) for x, c in at if c in nation[0] and x["l_suppkey"] in nation[1]]


def degrees(edges, at):
    out = {}
    for e in edges:
        n = out.setdefault(e[at], [0, 0, 0, 0])
        for i, one in enumerate((True, not e[2], e[3], e[3] and not e[2])):
            n[i] += one
    return sorted(((k, *n) for k, n in out.items()), key=repr)


def test_edges_are_all_lines(spark):
    want = rows(["src", "total", "intra", "test", "test_intra"], degrees(edges(), 1))
    assert found(spark, "degree_fold") == want


def test_refolded_degrees_count_all_lines(spark):
    gone = {s["s_suppkey"] for s in table("supplier") if s["s_acctbal"] < 2000}
    want = rows(["key", "total", "intra", "test", "test_intra"], degrees([e for e in edges() if e[1] not in gone], 0))
    assert found(spark, "removal_refold") == want


def test_orphans_have_no_other_user_on_any_line(spark):
    gone = {s["s_suppkey"] for s in table("supplier") if s["s_acctbal"] < 5000}
    used = {e[0] for e in edges() if e[1] not in gone}
    assert found(spark, "private_orphans") == rows(["key"], {(e[0],) for e in edges() if e[0] not in used})


def test_an_order_is_unused_only_without_lines(spark):
    by = {}
    for key, _, external, test, config in edges():
        by.setdefault(key, {}).setdefault(config, []).append((external, test))

    def usage(configs):
        each = list(configs.values())
        prod_cross = any(x and not t for c in each for x, t in c)
        any_cross, prod_intra = any(x for c in each for x, _ in c), any(not x and not t for c in each for x, t in c)
        return "CrossCrate" if prod_cross or (any_cross and prod_intra) else "IntraCrate" if prod_intra else "TestOnly" if each else "Unused"

    assert found(spark, "usage_verdict") == rows(["key", "usage"], [(o["o_orderkey"], usage(by.get(o["o_orderkey"], {}))) for o in table("orders")])


def test_union_verdict_leads_only_orders_without_lines(spark):
    by = {}
    for x in table("lineitem"):
        by.setdefault(x["l_orderkey"], set()).add(x["l_linestatus"] == "O")
    verdict = lambda k: ("lead", None) if k not in by else ("primary", None) if True in by[k] else ("retired", 1)
    assert found(spark, "union_verdict") == rows(["key", "verdict", "saver"], [(o["o_orderkey"], *verdict(o["o_orderkey"])) for o in table("orders")])


def test_centralized_deps_are_those_of_all_lines(spark):
    deps = {(x["l_suppkey"], x["l_orderkey"], x["l_linestatus"], x["l_returnflag"] != "R") for x in table("lineitem") if x["l_linenumber"] != 7}
    urgent = {o["o_orderkey"] for o in table("orders") if o["o_orderpriority"].startswith("1")}
    versions = {}
    for _, name, version, plain in deps:
        versions.setdefault(name, set()).add((version, plain))
    want = [(m, n, v, n in urgent, len(versions[n]) == 1 and n not in urgent) for m, n, v, _ in deps]
    assert {x[3:] for x in want} == {(True, False), (False, True), (False, False)}
    assert found(spark, "centralized_deps") == rows(["member", "name", "version", "shared", "seed"], want)


def write(d, lines, part):
    """lines: (order, line number, part, supplier, status), all of small quantity, discount and tax; part: (key, brand, size)."""
    li = [dict(zip(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus"), x), l_quantity=5.0, l_discount=0.01, l_tax=0.01) for x in lines]
    pq.write_table(pa.Table.from_pylist(li), f"{d}/lineitem.parquet")
    pq.write_table(pa.Table.from_pylist([dict(zip(("p_partkey", "p_brand", "p_size"), x)) for x in part]), f"{d}/part.parquet")
    return str(d)


def test_outcomes_of_lines_of_small_quantity(spark, tmp_path):
    d = write(
        tmp_path, [(1, 1, 1, 7, "O"), (1, 2, 2, 7, "O"), (2, 3, 2, 7, "F"), (2, 2, 3, 8, "O"), (3, 1, 1, 8, "O"), (3, 4, 4, 8, "F")],
        [(1, "Brand#12", 5), (2, "Brand#13", 9), (3, "Brand#13", 50), (4, "Brand#14", 45)],
    )
    assert found(spark, "emptied_modules", d) == rows(["config_id", "module"], [("O", 1), ("F", 2), ("O", 3), ("F", 3)])
    assert found(spark, "covering_config", d) == rows(["crate", "covering_ord"], [("Brand#12", 1), ("Brand#13", 2), ("Brand#14", 4)])
