"""Queries over the driver's tables that exercise the operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import clones, findings, graph, usage, verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Lines as references to orders: external across nations, test where returned."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    # the small tables first: lines are then dealt once, by the order, for the join and for what is folded by it
    users = graph.dealt(li.join(s, li.l_suppkey == s.s_suppkey), "l_orderkey", of=li)
    at = graph.dealt(o.join(c, o.o_custkey == c.c_custkey), "o_orderkey", of=li)
    j = users.join(at, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("src"), (F.col("s_nationkey") != F.col("c_nationkey")).alias("external"), (F.col("l_returnflag") == "R").alias("test"), F.col("l_linestatus").alias("config_id"))


EDGES = """e AS (SELECT l_orderkey AS key, l_suppkey AS src, s_nationkey <> c_nationkey AS external, l_returnflag = 'R' AS test, l_linestatus AS config_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
FLAGS = """f AS (SELECT key, bool_or(total - intra > test - test_intra) AS pc, bool_or(total > intra) AS ac, bool_or(intra > test_intra) AS pi FROM
 (SELECT key, config_id, count(*) AS total, count(*) FILTER (NOT external) AS intra, count(*) FILTER (test) AS test, count(*) FILTER (test AND NOT external) AS test_intra FROM e GROUP BY ALL) GROUP BY key)"""


@query(f"""WITH {EDGES}, {FLAGS} SELECT o_orderkey AS key, CASE WHEN pc OR (ac AND pi) THEN 'CrossCrate' WHEN pi THEN 'IntraCrate' WHEN key IS NOT NULL THEN 'TestOnly' ELSE 'Unused' END AS usage
 FROM orders LEFT JOIN f ON o_orderkey = key""")
def usage_verdict(spark, d):
    return usage.usage_verdict(t(spark, d, "orders").select(F.col("o_orderkey").alias("key")), _edges(spark, d))


@query(f"WITH {EDGES} SELECT src, count(*) AS total, count(*) FILTER (NOT external) AS intra, count(*) FILTER (test) AS test, count(*) FILTER (test AND NOT external) AS test_intra FROM e GROUP BY src")
def degree_fold(spark, d):
    return usage.degrees(_edges(spark, d), ["src"])


@query("""SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber, min(l_partkey) FILTER (l_linenumber = m) AS l_partkey FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_suppkey) AS m FROM lineitem) GROUP BY ALL""")
def distinct_edges(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    return usage.distinct_edges(li, ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey"])


@query("""WITH r AS (SELECT l_orderkey AS key, bool_or(l_linestatus = 'O') AS p, min(CASE WHEN l_linestatus <> 'O' THEN 1 END) AS saver FROM lineitem GROUP BY 1)
SELECT o_orderkey AS key, CASE WHEN p IS NULL THEN 'lead' WHEN p THEN 'primary' ELSE 'retired' END AS verdict, CASE WHEN NOT p THEN saver END AS saver FROM orders LEFT JOIN r ON o_orderkey = key""")
def union_verdict(spark, d):
    r = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("config_ord"))
    return usage.union_verdict(t(spark, d, "orders").select(F.col("o_orderkey").alias("key")), r)


@query("SELECT p_brand AS crate, min(l_linenumber) AS covering_ord FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def covering_config(spark, d):
    li = t(spark, d, "lineitem").select("l_partkey", "l_linenumber")
    j = li.join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("crate")), "l_partkey")
    return usage.covering_config(j, "crate", "l_linenumber")


@query(f"""WITH {EDGES}, x AS (SELECT l_partkey AS key, l_returnflag = 'R' AS test, l_linestatus = 'O' AS external FROM lineitem)
SELECT p_name AS identity, bool_or(external) AS any_cross, bool_or(NOT external) AS any_intra, bool_or(external AND NOT test) AS prod_cross, bool_or(NOT external AND NOT test) AS prod_intra
FROM x JOIN part ON key = p_partkey WHERE p_size > 25 GROUP BY 1""")
def foreign_credit(spark, d):
    e = t(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_returnflag") == "R").alias("test"), (F.col("l_linestatus") == "O").alias("external"))
    part = t(spark, d, "part")
    return usage.foreign_credit(e, part.where("p_size <= 25").select(F.col("p_partkey").alias("key")), part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("identity")))


@query(f"WITH {EDGES} SELECT key, count(*) AS total, count(*) FILTER (NOT external) AS intra, count(*) FILTER (test) AS test, count(*) FILTER (test AND NOT external) AS test_intra FROM e WHERE src NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) GROUP BY key")
def removal_refold(spark, d):
    gone = t(spark, d, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("src"))
    return usage.degrees(usage.excluding(_edges(spark, d), gone), ["key"])


@query(f"WITH {EDGES} SELECT DISTINCT key FROM e WHERE key NOT IN (SELECT key FROM e WHERE src NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000))")
def private_orphans(spark, d):
    gone = t(spark, d, "supplier").where("s_acctbal < 5000").select((-1 - F.col("s_suppkey")).alias("src"))
    e = _edges(spark, d).withColumn("src", -1 - F.col("src"))
    return usage.private_orphans(e, gone)


@query("""WITH g AS (SELECT l_linestatus AS config_id, l_orderkey AS module, bool_and(p_size <= 45) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT config_id, module FROM g WHERE x""")
def emptied_modules(spark, d):
    kids = t(spark, d, "lineitem").select(F.col("l_linestatus").alias("config_id"), F.col("l_orderkey").alias("module"), F.col("l_partkey").alias("key"))
    return usage.emptied_modules(kids, t(spark, d, "part").where("p_size <= 45").select(F.col("p_partkey").alias("key")))


@query("""WITH RECURSIVE s AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R' AND l_discount > 0.07),
a AS (SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT l.l_orderkey FROM lineitem l JOIN s ON l.l_orderkey = s.l_orderkey AND l.l_linenumber = s.l_linenumber)),
b AS (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a))),
n AS (SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM b)))
SELECT 'o' || o_orderkey AS node, 1 AS round FROM a UNION ALL SELECT 'c' || c_custkey, 2 FROM b UNION ALL SELECT 'n' || n_nationkey, 3 FROM n""")
def cascade_fixpoint(spark, d):
    li, o, c = t(spark, d, "lineitem"), t(spark, d, "orders"), t(spark, d, "customer")
    line = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), *[x for c in ("l_linenumber", "l_partkey", "l_suppkey") for x in (F.lit("-"), F.col(c).cast("string"))])
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    keep = "l_quantity > 49 and l_returnflag = 'R' and l_discount > 0.07"
    edges = (
        li.select(line.alias("src"), name("o", "l_orderkey").alias("dst"))
        .unionByName(o.select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst")))
        .unionByName(c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")))
    )
    nodes = o.select(name("o", "o_orderkey").alias("node")).unionByName(c.select(name("c", "c_custkey").alias("node"))).unionByName(t(spark, d, "nation").select(name("n", "n_nationkey").alias("node")))
    return graph.cascade(nodes, edges, li.where(f"not ({keep})").select(line.alias("node"))).where("round > 0").select("node", "round")


@query("""SELECT 's' || s_suppkey AS root, 's' || s_suppkey AS node FROM supplier UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def dep_closure(spark, d):
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    s, n = t(spark, d, "supplier"), t(spark, d, "nation")
    edges = s.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst")).unionByName(n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")))
    edges = edges.unionByName(n.select(name("r", "n_regionkey").alias("src"), name("r", "n_regionkey").alias("dst")))
    return graph.closure(s.select(name("s", "s_suppkey").alias("root"), name("s", "s_suppkey").alias("node")), edges)


@query("""SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')""")
def scaffold_shrink(spark, d):
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    uni = o.where("o_orderstatus = 'F'").select(name("o", "o_orderkey").alias("node")).unionByName(c.select(name("c", "c_custkey").alias("node")))
    return graph.closed_scaffold(uni, o.select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst")))


@query("""WITH x AS (SELECT sr.r_name || '::' || sn.n_name AS module, replace(cr.r_name, '-', '_') || '/' || cn.n_name AS claim, l_orderkey AS lo, cr.r_name AS cr, sr.r_name AS sr FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey)
SELECT 'asia-from-europe' AS rule, module, claim, min(lo) AS lo FROM x WHERE sr = 'ASIA' AND cr = 'EUROPE' GROUP BY ALL""")
def layer_rules(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("::", "r_name", "n_name").alias("p"))
    s = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("p").alias("module"))
    c = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws("::", "p", "c_mktsegment").alias("target"))
    li = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    j = li.join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    refs = j.groupBy("module", "target").agg(F.min("l_orderkey").alias("lo")).select("module", "target", F.lit(1).alias("pass_no"), F.lit("f").alias("file"), "lo")
    found = verdicts.layering(refs, [{"name": "asia-from-europe", "from": ["ASIA::*"], "deny": ["EUROPE::*"]}])
    return found.select("rule", "module", "claim", "lo")


@query("""WITH p AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS at_ FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS lo, floor(epoch(ts))::BIGINT + (value * 1000)::BIGINT AS hi FROM events)
SELECT event_id, user_id, at_, lo, hi FROM (SELECT p.*, lo, hi, row_number() OVER (PARTITION BY event_id ORDER BY hi - lo, lo) AS n FROM p JOIN s USING (user_id) WHERE lo <= at_ AND at_ < hi) WHERE n = 1""")
def innermost_interval(spark, d):
    e = t(spark, d, "events")
    at = F.unix_timestamp("ts")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", at.alias("at_"))
    return graph.innermost(p, e.select("user_id", at.alias("lo"), (at + F.round(F.col("value") * 1000).cast("long")).alias("hi")), "user_id", "at_", width=1 << 16)


@query("""SELECT p.event_id, p.user_id, p.ts, (SELECT max(v.ts) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts < p.ts) AS view_ts FROM events p WHERE event_type = 'purchase'""")
def reaching_bind(spark, d):
    e = t(spark, d, "events")
    return graph.latest_before(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'"), ["user_id"], "ts", F.col("ts"), "view_ts").select("event_id", "user_id", "ts", "view_ts")


@query("""WITH r AS (SELECT user_id, floor(epoch(ts))::BIGINT AS lo, floor(epoch(ts))::BIGINT + round(value * 60)::BIGINT AS hi FROM events), m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR lo > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n_ranges FROM i GROUP BY user_id, g""")
def range_coalesce(spark, d):
    at = F.unix_timestamp("ts")
    return graph.coalesce_ranges(t(spark, d, "events").select("user_id", at.alias("lo"), (at + F.round(F.col("value") * 60).cast("long")).alias("hi")), ["user_id"])


def _regions(spark, d, fp) -> DataFrame:
    return t(spark, d, "documents").select(fp.alias("fp"), F.length("text").alias("n_tokens"), F.col("source").alias("file"), F.col("source").alias("crate"), F.col("doc_id").alias("line"), F.col("doc_id").alias("end_line"))


@query("SELECT md5(text) AS fp, count(*) AS n_instances, min(doc_id) AS first_doc FROM documents GROUP BY md5(text), length(text) HAVING count(*) >= 2")
def doc_clones(spark, d):
    g = clones.clone_groups(_regions(spark, d, F.md5("text")))
    return g.select("fp", "n_instances", F.array_min(F.transform("instances", lambda x: x["line"])).alias("first_doc"))


@query("SELECT md5(text) AS fp, count(*) AS n_instances, count(DISTINCT source) AS n_crates FROM documents GROUP BY md5(text), length(text) HAVING count(*) >= 2 AND count(DISTINCT source) >= 2")
def cross_source_clones(spark, d):
    g = clones.clone_groups(_regions(spark, d, F.md5("text")), cross_crate=True)
    return g.join(_regions(spark, d, F.md5("text")), ["fp", "n_tokens"]).groupBy("fp").agg(F.max("n_instances").alias("n_instances"), F.count_distinct("crate").alias("n_crates"))


@query("SELECT md5(regexp_replace(text, '[0-9]+', '0', 'g')) AS fp, count(*) AS n_instances FROM documents GROUP BY 1 HAVING count(*) >= 2")
def normalized_clones(spark, d):
    fp = F.md5(F.regexp_replace("text", "[0-9]+", "0"))
    return clones.clone_groups(_regions(spark, d, fp).withColumn("n_tokens", F.lit(0))).select("fp", "n_instances")


@query("SELECT md5(l) AS fp, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def line_clones(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.length("l") >= 40)
    return x.groupBy(F.md5("l").alias("fp")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs")).where("n_docs >= 2")


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS s FROM benchmark), g AS (SELECT item_id, unnest(CASE WHEN len(s) >= 4 THEN list_transform(range(1, len(s) - 2), lambda i: array_to_string(s[i:i+3], ' ')) ELSE [] END) AS x FROM w)
SELECT w.item_id, coalesce(round(count(DISTINCT x)::DOUBLE / nullif(count(x), 0), 6), 1.0) AS ratio FROM w LEFT JOIN g USING (item_id) GROUP BY 1""")
def rolling_window_ratio(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.round(clones.non_repeating_ratio(F.split("text", " "), 4), 6).alias("ratio"))


@query("""WITH c AS (SELECT md5(text) AS fp, count(*) AS now FROM documents GROUP BY 1), b AS (SELECT md5(text) AS fp, count(*) AS was FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT fp, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'orphan' WHEN now > was THEN 'grew' WHEN now < was THEN 'overcount' ELSE 'covered' END AS verdict FROM c FULL JOIN b USING (fp)""")
def baseline_ratchet(spark, d):
    doc = t(spark, d, "documents").select("doc_id", F.md5("text").alias("fp"), F.lit(0).alias("n_tokens"))
    count = lambda x: x.groupBy("fp", "n_tokens").agg(F.count("*").alias("n_instances"))
    return clones.ratchet(count(doc), count(doc.join(t(spark, d, "labels").select("doc_id"), "doc_id"))).select("fp", "verdict")


@query("SELECT source || '/' || doc_id AS path, n_chars AS lines, 'src1*/*' AS glob, CAST(4000 AS BIGINT) AS most FROM documents WHERE source LIKE 'src1%' AND n_chars > 4000 UNION ALL SELECT source || '/' || doc_id, n_chars, '**', CAST(9000 AS BIGINT) FROM documents WHERE n_chars > 9000")
def budget_file(spark, d):
    f = t(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("lines"))
    return verdicts.over_budget(f, [("src1*/*", 4000), ("**", 9000)])


@query("SELECT source, sum(n_chars)::BIGINT AS total FROM documents GROUP BY 1 HAVING sum(n_chars) > 20000")
def budget_crate(spark, d):
    return verdicts.group_over_budget(t(spark, d, "documents"), "source", "n_chars", 20000)


@query("""WITH u AS (SELECT DISTINCT lang AS crate, source AS feature FROM documents JOIN labels USING (doc_id) WHERE toxic = 1), d AS (SELECT DISTINCT lang AS crate, source AS feature FROM documents WHERE n_chars > 3000)
SELECT *, 'declared-never-gated' AS drift FROM (SELECT * FROM d EXCEPT SELECT * FROM u) UNION ALL SELECT *, 'gated-undeclared' FROM (SELECT * FROM u EXCEPT SELECT * FROM d)""")
def drift_two_sided(spark, d):
    doc = t(spark, d, "documents")
    names = [F.col("lang").alias("crate"), F.col("source").alias("feature")]
    declared = doc.where("n_chars > 3000").select(*names).distinct().withColumn("activates", F.array().cast("array<string>"))
    return verdicts.feature_drift(declared, doc.join(t(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id").select(*names))


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS path, CASE WHEN l.doc_id IS NOT NULL THEN 'live' WHEN n_chars > 2000 THEN 'coverage-gap' ELSE 'orphan' END AS verdict FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def orphan_classify(spark, d):
    path = F.col("doc_id").cast("string").alias("path")
    doc = t(spark, d, "documents")
    return verdicts.orphan_files(doc.select(path), t(spark, d, "labels").select(path), doc.where("n_chars > 2000").select(path))


def _findings(spark, d):
    f = t(spark, d, "documents").where("n_chars > 3000").select(F.col("doc_id").alias("fid"), F.lit("size").alias("lint"), F.col("source").alias("file"), F.col("doc_id").alias("line"), F.col("lang").alias("crate"))
    x = t(spark, d, "documents").join(t(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id")
    line = x.select(F.col("doc_id").alias("did"), F.lit("size").alias("lint"), F.lit("line").alias("scope"), F.col("source").alias("file"), F.col("doc_id").alias("line"), F.lit(None).cast("string").alias("crate"), F.lit("expect").alias("kind"))
    whole = spark.range(1).select(F.lit(-1).cast("long").alias("did"), F.lit("size").alias("lint"), F.lit("file").alias("scope"), F.lit("src7").alias("file"), F.lit(0).cast("long").alias("line"), F.lit(None).cast("string").alias("crate"), F.lit("allow").alias("kind"))
    return f, line.unionByName(whole)


HIT = "f AS (SELECT doc_id, source FROM documents WHERE n_chars > 3000), x AS (SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 0)"


@query(f"WITH {HIT} SELECT f.doc_id AS fid, f.source AS file FROM f WHERE source <> 'src7' AND NOT EXISTS (SELECT 1 FROM x WHERE x.source = f.source AND f.doc_id BETWEEN x.doc_id AND x.doc_id + 3)")
def suppress(spark, d):
    return findings.suppress(*_findings(spark, d)).select("fid", "file")


@query(f"WITH {HIT} SELECT x.source AS file, x.doc_id AS line, 'size' AS lint FROM x WHERE NOT EXISTS (SELECT 1 FROM f WHERE x.source = f.source AND f.doc_id BETWEEN x.doc_id AND x.doc_id + 3)")
def stale_expect(spark, d):
    f, x = _findings(spark, d)
    ran = spark.range(1).select(F.lit("size").alias("lint"))
    return findings.stale_expects(f, x, ran).select("file", "line", F.explode("stale").alias("lint"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN 'deny' END, CASE WHEN o_totalprice > 200000 THEN 'warn' END, CASE WHEN o_orderpriority LIKE '1%' THEN CASE WHEN o_orderstatus = 'F' THEN 'warn' ELSE 'allow' END END, 'warn') AS level FROM orders""")
def levels_cascade(spark, d):
    none = F.lit(None).cast("string")
    level = verdicts.effective_level(F.when(F.col("o_orderstatus") == "P", "deny"), F.when(F.col("o_totalprice") > 200000, "warn"), F.when(F.col("o_orderpriority").startswith("1"), "allow"), none, none, F.col("o_orderstatus") == "F")
    return t(spark, d, "orders").select("o_orderkey", level.alias("level"))


@query("""WITH p AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS s FROM pages), q AS (SELECT unnest(CASE WHEN len(s) >= 2 THEN list_transform(range(2, len(s) + 1), lambda n: array_to_string(s[1:n], '/')) ELSE [] END) AS prefix FROM p) SELECT prefix, count(*) AS n FROM q GROUP BY 1""")
def path_prefixes(spark, d):
    s = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    return t(spark, d, "pages").select(F.explode(F.transform(P.canonical_prefixes(s), P.segments_glob_form)).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


@query("""SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::BIGINT AS n_refs FROM pages""")
def page_refs(spark, d):
    return t(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("n_refs"))


@query("""WITH i AS (SELECT DISTINCT l_suppkey AS member, l_orderkey AS name, l_linestatus AS version, l_returnflag <> 'R' AS df FROM lineitem WHERE l_linenumber <> 7),
a AS (SELECT name, count(DISTINCT (version, df)) = 1 AS agree FROM i GROUP BY 1), w AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority LIKE '1%')
SELECT member, name, version, name IN (SELECT k FROM w) AS shared, agree AND name NOT IN (SELECT k FROM w) AS seed FROM i JOIN a USING (name)""")
def centralized_deps(spark, d):
    """Suppliers as members that ask for orders; line 7 takes the workspace's version, urgent orders are shared."""
    li = t(spark, d, "lineitem")
    deps = li.select(
        F.col("l_suppkey").alias("member"), F.col("l_orderkey").alias("name"), F.col("l_linestatus").alias("version"), (F.col("l_returnflag") != "R").alias("default_features"),
        (F.col("l_linenumber") == 7).alias("uses_workspace"), F.lit(False).alias("is_path"),
    ).distinct()
    shared = t(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("name"))
    return verdicts.centralized(deps, shared).select("member", "name", "version", "shared", "seed")


@query("""SELECT c_custkey, CASE WHEN n_nationkey <= 12 THEN r_name || '::' || n_name ELSE r_name END AS module FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def enclosing_module(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws("::", "r_name", "n_name", "c_mktsegment").alias("path"))
    mods = n.where("n_nationkey <= 12").select(F.concat_ws("::", "r_name", "n_name").alias("m")).unionByName(n.select(F.col("r_name").alias("m")))
    return graph.nearest_prefix(at, "path", mods, "m", "module").select("c_custkey", "module")


@query("SELECT level, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'deny' ELSE 'warn' END AS level FROM orders) GROUP BY 1")
def finding_summary(spark, d):
    return findings.summary(t(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "deny").otherwise("warn").alias("level")))


@query("""SELECT '::' || CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'warning' END || ' file=' || CASE WHEN o_orderstatus = 'O' THEN replace(o_orderpriority, ':', '%3A') || ',line=' || o_orderkey || ',col=7' WHEN o_orderkey % 4 = 0 THEN 'a/b.rs,line=' || o_custkey || ',col=1'
 WHEN o_orderkey % 4 = 1 THEN 'a/b.rs,line=1,col=1' WHEN o_orderkey % 4 = 2 THEN 'crates/x/Cargo.toml,line=1,col=1' ELSE 'Cargo.toml,line=1,col=1' END || ',title=t%3A1::order ' || o_orderstatus || ' 5%25' AS value FROM orders""")
def render_github(spark, d):
    own = F.col("o_orderstatus") == "O"
    scope = F.element_at(F.array(*map(F.lit, ("line", "file", "crate", "workspace"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    f = t(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "P", "error").otherwise("warning").alias("level"), F.lit("t:1").alias("lint"), F.concat(F.lit("order "), "o_orderstatus", F.lit(" 5%")).alias("message"),
        F.when(own, F.col("o_orderpriority")).alias("file"), F.when(own, F.col("o_orderkey")).alias("line"), F.lit(7).alias("col"), scope.alias("scope"), F.lit("a\\b.rs").alias("anchor_file"), F.col("o_custkey").alias("anchor_line"),
        F.lit("crates/x").alias("manifest_dir"),
    )
    return findings.render(f, "github")
