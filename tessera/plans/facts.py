"""Stand-in fact tables over the driver's tables: one list of columns gives both the DataFrame and the SQL.

Parts are definitions in blocks of ten (a module, a trait, a type, its field and variant, functions, a constant), in one or two
configs; lines are reference edges between them. The tables are written once a query, as fact tables are read, since their expressions are long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import cut, dealt


def div(x: str, n: int) -> str:
    return f"CAST(floor(({x}) / {n}.0) AS BIGINT)"


def block(k: str) -> str:
    return div(k, 10)


def home(k: str) -> str:
    """The module of a block: 35 top modules, and modules inside these from block 35 on."""
    b = block(k)
    top = f"concat('c', {b} % 5, '::m', {b} % 7)"
    return f"CASE WHEN {b} < 35 THEN {top} ELSE concat({top}, '::n', {b}) END"


def path(k: str) -> str:
    b, h = block(k), f"({home(k)})"
    variant = f"concat({h}, '::S', {b}, '::V', {b})"
    return (
        f"CASE {k} % 10 WHEN 0 THEN {h} WHEN 1 THEN concat({h}, '::T', {b}) WHEN 2 THEN concat({h}, '::S', {b})"
        f" WHEN 3 THEN CASE WHEN {b} % 2 = 1 THEN concat({variant}, '::f', {b}) ELSE concat({h}, '::S', {b}, '::f', {b}) END"
        f" WHEN 4 THEN {variant} WHEN 5 THEN concat({h}, '::fn', {b}) WHEN 6 THEN concat({h}, '::S', {b}, CASE WHEN {b} % 3 = 0 THEN '::is_empty' ELSE '::new' END)"
        f" WHEN 7 THEN concat({h}, '::T', {b}, '::go') WHEN 8 THEN concat({h}, '::<impl T for S', {b}, '>::go') ELSE concat({h}, '::S', {b}, '::len') END"
    )


ROLE = "p_partkey % 10"
DEFS = {
    "cfg": "cfg", "key": "p_partkey", "path": path("p_partkey"), "krate": f"concat('c', {block('p_partkey')} % 5)",
    "kind": f"CASE {ROLE} WHEN 0 THEN 'mod' WHEN 1 THEN 'trait' WHEN 2 THEN CASE WHEN {block('p_partkey')} % 2 = 1 THEN 'enum' ELSE 'struct' END WHEN 3 THEN 'field' WHEN 4 THEN 'variant' ELSE 'fn' END",
    "parent_kind": f"CASE WHEN {ROLE} IN (0, 1, 2, 5) THEN 'mod' WHEN {ROLE} = 7 THEN 'trait' WHEN {ROLE} IN (3, 4) THEN 'struct' ELSE 'impl' END",
    "trait_item": f"CASE WHEN {ROLE} = 8 THEN CASE WHEN {block('p_partkey')} % 4 = 0 THEN -1 ELSE p_partkey - 1 END END",
    "self_type": f"CASE WHEN {ROLE} IN (6, 9) THEN p_partkey - p_partkey % 10 + 2 END",
    "public": "p_size % 4 <> 0", "synthetic": "p_size = 13", "export_root": "p_size = 49", "from_expansion": "p_size = 27", "self_kind": "CASE WHEN p_size % 2 = 0 THEN 'value' ELSE 'ref' END",
    "file": f"concat('src/', {home('p_partkey')}, '.rs')", "lo": f"CASE WHEN p_size = 31 THEN NULL ELSE ({ROLE}) * 100 END", "hi": f"({ROLE}) * 100 + 150",
}
FROM = "(l_orderkey * 13 + l_linenumber * 17) % 200"
EDGES = {
    "cfg": "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END", "krate": f"concat('c', {block(FROM)} % 5)", "target_kind": "CASE WHEN l_suppkey % 10 = 0 THEN 'test' WHEN l_suppkey % 10 = 1 THEN 'build' WHEN l_suppkey % 10 = 2 THEN 'bin' ELSE 'lib' END",
    "is_test_cfg": "l_returnflag = 'R'", "from_key": FROM, "from_path": path(FROM), "to_key": "l_partkey", "to_path": path("l_partkey"),
    "to_kind": "CASE WHEN l_quantity > 48 THEN 'param' ELSE 'fn' END", "external": f"{block(FROM)} % 5 <> {block('l_partkey')} % 5", "import": "l_linenumber % 5 = 4", "reexport": "l_linenumber % 5 = 4 AND l_quantity > 25",
    "glob": "l_linenumber % 5 = 4 AND l_discount > 0.05", "trait_scope": "l_linenumber = 6 AND l_quantity < 10", "in_signature": "l_returnflag = 'A' AND l_linenumber = 1",
    "own_key": "CASE WHEN l_suppkey % 7 = 0 THEN l_partkey END", "via": "CASE WHEN l_tax > 0.05 THEN 'c9' END", "file": f"concat('src/', {home(FROM)}, '.rs')", "lo": "l_orderkey % 1000",
    "elem": "l_orderkey", "unit": "l_suppkey",
}


def _select(columns: dict[str, str], names) -> list[str]:
    return [f"{columns[n]} AS {n}" for n in names or columns]


def defs(spark: SparkSession, d: str, *names: str) -> DataFrame:
    p = dealt(spark.read.parquet(f"{d}/part.parquet"), "p_partkey", rows=50_000).selectExpr("*", "explode(array(0, 1)) AS cfg").where("cfg = 0 OR p_size > 20")
    return cut(p.selectExpr(*_select(DEFS, names)))


def edges(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return cut(spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*_select(EDGES, names)))


def defs_sql(*names: str) -> str:
    return f"d AS (SELECT {', '.join(_select(DEFS, names))} FROM part, (VALUES (0), (1)) r(cfg) WHERE cfg = 0 OR p_size > 20)"


def edges_sql(*names: str) -> str:
    return f"e AS (SELECT {', '.join(_select(EDGES, names))} FROM lineitem)"
