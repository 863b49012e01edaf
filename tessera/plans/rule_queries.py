"""Queries of scalars, clones, findings, dependencies and housekeeping over stand-in facts, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import clones, findings, graph, model, shadow, usage, verdicts
from .queries import query, t


def pick(values: tuple[str, ...], k: str = "p_partkey"):
    """The k-th of some texts (cyclic); `pick_sql` says the same in SQL."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(k) % len(values) + 1).cast("int"))


def pick_sql(values: tuple[str, ...], k: str = "p_partkey") -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[{k} % {len(values)} + 1]"


NAMES = ("HTTPServerName2", "FooBar", "parseXMLDoc", "A", "lower", "IOError", "X1Y", "toUTF8String")
PATHS = ("crates\\a\\src\\lib.rs", "/w/crates/a/src/x.rs", "tests/t.rs", "/w/benches/b.rs", "src/lib.rs")
CRATES = ("my-crate", "a_b-c", "plain", "x--y")
LITS = ("0", "1", "0usize", "1.0", "0_u8", "12", '""', '"a"', "00", "0x10", "1.5f32", "'c'", "b'x'", "true", "1_0")
DEPS = ("dep:serde", "x?/std", "tokio/full", "bare", "default")
TYPES = ("&'a mut std::vec::Vec<T>", "Option<u8>", "&str", "a::b::C", "Self")
TRIPLES = ("x86_64-unknown-linux-gnu", "aarch64-apple-darwin", "x86_64-pc-windows-msvc", "wasm32-unknown-unknown", "x86_64-unknown-linux-musl", "riscv64-foo-bar", "wasm32-wasi", "x86_64-pc-windows-gnu", "x86_64-unknown-freebsd")


@query(f"""SELECT p_partkey, string_split(regexp_replace(regexp_replace({pick_sql(NAMES)}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' ') AS words, replace(replace({pick_sql(CRATES)}, '-', ''), '_', '') AS stripped, replace({pick_sql(CRATES)}, '-', '_') AS code,
 replace({pick_sql(PATHS)}, '\\', '/') AS display, CASE WHEN starts_with({pick_sql(PATHS)}, '/w/') THEN substr({pick_sql(PATHS)}, 4) ELSE {pick_sql(PATHS)} END AS relative, split_part({pick_sql(PATHS)}, '/', 1) IN ('tests', 'benches', 'examples') AS dev,
 {pick_sql(PATHS)} = 'src/lib.rs' OR ends_with({pick_sql(PATHS)}, '/src/lib.rs') AS same, regexp_extract({pick_sql(TYPES)}, '(?:^|[&: ])([A-Za-z0-9_]+)(?:<.*)?$', 1) AS base, 'a::b' = p OR starts_with(p, 'a::b::') AS covered, split_part(p, '::', -1) = 'c' AS trait_same
 FROM (SELECT *, {pick_sql(("a::b", "a::bc", "a::b::c", "x::c"))} AS p FROM part)""")
def name_scalars(spark, d):
    x = t(spark, d, "part").withColumn("p", pick(("a::b", "a::bc", "a::b::c", "x::c")))
    path, crate = pick(PATHS), pick(CRATES)
    return x.select(
        "p_partkey", P.camel_words(pick(NAMES)).alias("words"), P.separator_stripped(crate).alias("stripped"), P.code_name(crate).alias("code"), P.display_path(path).alias("display"), P.relative_path(path, "/w").alias("relative"),
        P.in_dev_target_dir(path).alias("dev"), P.same_file(path, F.lit("src/lib.rs")).alias("same"), P.type_base(pick(TYPES)).alias("base"), P.covers(F.col("p"), F.lit("a::b")).alias("covered"), P.traits_match(F.col("p"), F.lit("q::c")).alias("trait_same"),
    )


@query(f"""SELECT p_partkey, {pick_sql(LITS)} IN ('0', '1', '0usize', '1.0', '0_u8', '""', '00') AS sentinel, CASE WHEN {pick_sql(LITS)} LIKE '"%' THEN '$str' WHEN {pick_sql(LITS)} LIKE '''%' OR {pick_sql(LITS)} LIKE 'b''%' THEN '$char' WHEN {pick_sql(LITS)} IN ('1.0', '1.5f32') THEN '$float' WHEN regexp_matches({pick_sql(LITS)}, '^[0-9]') THEN '$int' ELSE '$lit' END AS kind,
 CASE p_partkey % 5 WHEN 0 THEN 'serde' WHEN 1 THEN 'x' WHEN 2 THEN 'tokio' END AS dep, CASE WHEN p_size > 30 THEN 'a, b, and 1 more' ELSE 'a, b' END AS capped, CASE WHEN p_size % 2 = 0 THEN 'src/x.rs:7' ELSE '' END AS sites, (p_size % 3 <> 1)::INT + (p_brand <> 'Brand#1')::INT AS apart,
 CASE WHEN p_size > 25 THEN p_size > 40 WHEN p_size > 40 THEN true ELSE false END AS both_, p_size > 40 OR p_size <= 25 AS either_, regexp_extract(p_name || ' ' || p_size || '.2', '([0-9]+[.][0-9]+)', 1) AS version, p_brand = 'Brand#1' AS word FROM part""")
def literal_scalars(spark, d):
    lit = pick(LITS)
    items = F.when(F.col("p_size") > 30, F.array(*map(F.lit, "abc"))).otherwise(F.array(*map(F.lit, "ab")))
    site = F.struct(F.lit("src\\x.rs").alias("file"), F.lit(7).alias("line"))
    sites = F.when(F.col("p_size") % 2 == 0, F.array(site, site)).otherwise(F.array(site))
    known = {"big": F.col("p_size") > 25, "huge": F.when(F.col("p_size") > 25, F.col("p_size") > 40)}
    return t(spark, d, "part").select(
        "p_partkey", P.is_sentinel(lit).alias("sentinel"), P.literal_placeholder(lit).alias("kind"), P.feature_dependency(pick(DEPS)).alias("dep"), P.capped_list(items, 2).alias("capped"), P.other_sites(sites).alias("sites"),
        P.diff_count(F.array((F.col("p_size") % 3).cast("string"), F.col("p_brand")), F.array(F.lit("1"), F.lit("Brand#1"))).alias("apart"), P.cfg_predicate(("all", "big", "huge"), known).alias("both_"),
        P.cfg_predicate(("any", ("not", "big"), ("all", "huge", "odd")), known | {"odd": F.when(F.col("p_size") > 40, True)}).alias("either_"), P.extract_version(F.concat(F.lit("\x1b[1m"), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(".2")), "([0-9]+[.][0-9]+)").alias("version"),
        P.word_match(F.concat(F.lit("x "), "p_brand", F.lit(" y")), F.lit("Brand#1")).alias("word"),
    )


@query(f"""SELECT p_partkey, a.arch AS arch, a.os AS os, a.family AS family, a.env AS env FROM (SELECT p_partkey, (MAP {{'x86_64-unknown-linux-gnu': {{'arch': 'x86_64', 'os': 'linux', 'family': 'unix', 'env': 'gnu'}}, 'aarch64-apple-darwin': {{'arch': 'aarch64', 'os': 'macos', 'family': 'unix', 'env': ''}},
 'x86_64-pc-windows-msvc': {{'arch': 'x86_64', 'os': 'windows', 'family': 'windows', 'env': 'msvc'}}, 'wasm32-unknown-unknown': {{'arch': 'wasm32', 'os': 'unknown', 'family': 'wasm', 'env': ''}}, 'x86_64-unknown-linux-musl': {{'arch': 'x86_64', 'os': 'linux', 'family': 'unix', 'env': 'musl'}},
 'riscv64-foo-bar': {{'arch': 'riscv64', 'os': NULL, 'family': NULL, 'env': NULL}}, 'wasm32-wasi': {{'arch': 'wasm32', 'os': 'wasi', 'family': 'wasm', 'env': ''}}, 'x86_64-pc-windows-gnu': {{'arch': 'x86_64', 'os': 'windows', 'family': 'windows', 'env': 'gnu'}},
 'x86_64-unknown-freebsd': {{'arch': 'x86_64', 'os': 'freebsd', 'family': 'unix', 'env': ''}}}})[{pick_sql(TRIPLES)}] AS a FROM part)""")
def triple_axes(spark, d):
    return t(spark, d, "part").select("p_partkey", shadow.triple_axes(pick(TRIPLES)).alias("a")).select("p_partkey", "a.arch", "a.os", "a.family", "a.env")


KEYS = ("target_os", "target_family", "feature", "unix", "test", "vendor", "debug_assertions")


@query(f"""SELECT p_partkey, CASE WHEN k = 'target_os' THEN CASE WHEN tr = 'riscv64-foo-bar' THEN NULL ELSE contains(tr, 'linux') END WHEN k = 'target_family' THEN CASE WHEN tr = 'riscv64-foo-bar' THEN NULL ELSE contains(tr, 'linux') OR contains(tr, 'darwin') OR contains(tr, 'freebsd') END
 WHEN k = 'feature' THEN CASE WHEN p_size % 3 = 0 THEN true END WHEN k = 'unix' THEN CASE WHEN tr = 'riscv64-foo-bar' THEN NULL ELSE contains(tr, 'linux') OR contains(tr, 'darwin') OR contains(tr, 'freebsd') END WHEN k = 'test' THEN p_size > 20 WHEN k = 'debug_assertions' THEN true END AS truth FROM (SELECT *, {pick_sql(KEYS)} AS k, {pick_sql(TRIPLES, 'p_size')} AS tr FROM part)""")
def cfg_atoms(spark, d):
    x = t(spark, d, "part").withColumn("k", pick(KEYS)).withColumn("a", shadow.triple_axes(pick(TRIPLES, "p_size")))
    value = F.when(F.col("k") == "target_os", "linux").when(F.col("k") == "target_family", "unix").when(F.col("k").isin("feature", "vendor"), "f")
    on, none = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")), F.array().cast("array<string>")
    return x.select("p_partkey", shadow.atom(F.col("k"), value, F.col("a"), F.col("p_size") > 20, on, none, none, F.lit(False), F.lit(False)).alias("truth"))


METHODS = ("new", "to_mut", "to_a_mut", "to_x", "as_x", "from_x", "into_x", "is_x", "run")
KINDS = ("none", "value", "ref", "ref_mut")


@query(f"""SELECT p_partkey, NOT CASE WHEN m = 'new' THEN k = 'none' WHEN m IN ('to_mut', 'to_a_mut') THEN rm WHEN m = 'to_x' THEN CASE WHEN cp AND NOT tr THEN k = 'value' ELSE rf END WHEN m = 'as_x' THEN rf OR rm WHEN m = 'from_x' THEN k = 'none' WHEN m = 'into_x' THEN k = 'value' WHEN m = 'is_x' THEN rf OR k = 'none' ELSE true END AS violation,
 CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS naming FROM (SELECT *, k = 'ref' OR (cp AND k = 'value') AS rf, k = 'ref_mut' OR (cp AND k = 'value') AS rm FROM (SELECT *, {pick_sql(METHODS)} AS m, {pick_sql(KINDS, 'p_size')} AS k, p_size % 5 = 0 AS cp, p_size % 3 = 0 AS tr FROM part))""")
def naming_rules(spark, d):
    variants = (("FooA", "FooB", "FooC"), ("FooA", "BarB", "C"), ("ABad", "CBad", "DBad"), ("OwnerX", "B"), ("OwnerX", "Bee", "Cee"))
    lists = F.array(*[F.array(*map(F.lit, v)) for v in variants])
    return t(spark, d, "part").select(
        "p_partkey", P.convention_violation(pick(METHODS), pick(KINDS, "p_size"), F.col("p_size") % 5 == 0, F.col("p_size") % 3 == 0).alias("violation"),
        P.variant_naming_hit(F.lit("Owner"), F.element_at(lists, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("naming"),
    )


@query("""SELECT p_partkey, CASE WHEN h >= 9223372036854775808 THEN (h - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS h FROM (SELECT p_partkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h FROM part)""")
def fnv_digest(spark, d):
    return t(spark, d, "part").select("p_partkey", P.fnv1a("p_name").alias("h"))


@query("""SELECT doc_id, CASE WHEN n < 2 THEN NULL ELSE o[1] END AS lo, CASE WHEN n < 2 THEN NULL ELSE least(o[1] + o[2], total) END AS hi FROM (SELECT doc_id, len(s) AS n, [strlen(s[1]) + 1, strlen(s[2]) + 1] AS o, strlen(text) AS total FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents)) WHERE n < 2 OR least(o[1] + o[2], total) > o[1]""")
def second_line_span(spark, d):
    s = t(spark, d, "documents").where("text is not null").select("doc_id", X.line_span(F.col("text"), F.lit(2), F.lit(2)).alias("s"), F.size(F.split("text", "\n")).alias("n"))
    return s.where("s is not null or n < 2").select("doc_id", "s.lo", "s.hi")


@query("""WITH x AS (SELECT p_partkey AS k, 'c' || (p_partkey % 5) || '::' || p_type || '::' || p_name AS path FROM part WHERE p_partkey % 3 > 0), e AS (SELECT l_orderkey, l_linenumber, l_partkey AS to_key, 'c' || (l_partkey % 5) || '::alias::' || p_name AS to_path FROM lineitem JOIN part ON l_partkey = p_partkey),
ix AS (SELECT p_partkey AS g, 'c' || (p_partkey % 5) || '::' || p_type || '::' || p_name AS i FROM part WHERE p_size > 25), bp AS (SELECT path, min(k) AS k FROM x GROUP BY 1), sx AS (SELECT split_part(path, '::', 1) AS r, split_part(path, '::', -2) || '::' || split_part(path, '::', -1) AS s, min(k) AS k FROM x GROUP BY ALL HAVING count(*) = 1)
SELECT l_orderkey, l_linenumber, to_key, coalesce(x.k, b2.k, b3.k, sx.k) AS resolved FROM e LEFT JOIN x ON e.to_key = x.k LEFT JOIN ix ON e.to_key = ix.g LEFT JOIN bp b2 ON ix.i = b2.path LEFT JOIN bp b3 ON e.to_path = b3.path LEFT JOIN sx ON split_part(to_path, '::', 1) = sx.r AND split_part(to_path, '::', -2) || '::' || split_part(to_path, '::', -1) = sx.s""")
def resolve_targets(spark, d):
    p = t(spark, d, "part")
    path = F.concat_ws("::", F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string")), "p_type", "p_name")
    local = p.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("key"), path.alias("path"))
    index = p.where("p_size > 25").select(F.col("p_partkey").alias("key"), path.alias("identity"))
    to = F.concat_ws("::", F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string")), F.lit("alias"), "p_name")
    e = t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("to_key"), to.alias("to_path"))
    return usage.resolve(e, local, index).select("l_orderkey", "l_linenumber", "to_key", "resolved")


LITERALS = """li AS (SELECT o_custkey AS gid, o_orderkey AS instance, pos, v AS text FROM (SELECT o_custkey, o_orderkey, unnest([0, 1, 2, 3, 4]) AS pos, unnest([o_orderstatus, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN 'F' ELSE o_orderstatus END, substr(o_orderpriority, 1, 1), 'k']) AS v FROM orders)),
co AS (SELECT gid, pos, list(text ORDER BY instance) AS v FROM li GROUP BY ALL), cl AS (SELECT gid, v, count(*) AS support, min(pos) AS first_pos, len(list_distinct(v)) > 1 AS divergent FROM co GROUP BY ALL)"""


def literals(spark, d):
    o = t(spark, d, "orders")
    cols = F.array("o_orderstatus", "o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "F").otherwise(F.col("o_orderstatus")), F.substring("o_orderpriority", 1, 1), F.lit("k"))
    return clones.divergence(o.select(F.col("o_custkey").alias("gid"), F.col("o_orderkey").alias("instance"), F.posexplode(cols).alias("pos", "text")))


@query(f"WITH {LITERALS} SELECT gid, sum(support)::BIGINT AS positions, coalesce(sum(support) FILTER (divergent), 0)::BIGINT AS divergent, count(*) FILTER (divergent) AS params FROM cl GROUP BY 1")
def literal_divergence(spark, d):
    return clones.divergence_stats(literals(spark, d))


VIOLATIONS = f"""{LITERALS}, nr AS (SELECT a.gid, a.first_pos AS pos, a.v AS d, b.v AS o, b.support, b.first_pos AS dp FROM cl a JOIN cl b ON a.gid = b.gid WHERE a.support = 1 AND b.divergent AND b.support >= 2 AND len(list_filter(range(1, len(a.v) + 1), lambda i: a.v[i] <> b.v[i])) = 1),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid, pos ORDER BY support DESC, dp DESC) AS n FROM nr) WHERE n = 1), vi AS (SELECT gid, pos, list_filter(range(1, len(d) + 1), lambda i: d[i] <> o[i])[1] AS i, d, o FROM be),
vo AS (SELECT gid, pos, (i - 1)::INT AS instance, d[i] AS found, o[i] AS expected FROM vi WHERE len(list_filter(range(1, len(o) + 1), lambda j: j <> i AND o[j] = d[i])) > 0 AND d[i] NOT IN ('0', '1') AND o[i] NOT IN ('0', '1'))"""


@query(f"WITH {VIOLATIONS} SELECT * FROM vo")
def literal_drift(spark, d):
    return clones.violations(literals(spark, d))


@query(f"""WITH {VIOLATIONS}, st AS (SELECT gid, sum(support) AS positions, count(*) FILTER (divergent) AS params FROM cl GROUP BY 1), m AS (SELECT st.*, count(vo.gid) AS drift FROM st LEFT JOIN vo ON st.gid = vo.gid GROUP BY ALL)
SELECT 'params' AS what, params::INT AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'identical', NULL, count(*) FILTER (params = 0) FROM m UNION ALL SELECT 'suppressed', k, count(*) FILTER (drift = 0 AND params > k) FROM m, range(2, 6) t(k) GROUP BY 2 UNION ALL SELECT 'drift', NULL, sum(drift)::BIGINT FROM m""")
def clone_stats(spark, d):
    classes = literals(spark, d)
    one = F.array(F.struct(F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit(2).alias("end_line")))
    groups = classes.select("gid").distinct().select("gid", F.lit("x").alias("fp"), F.lit(1).alias("n_tokens"), one.alias("instances"))
    return clones.stats_readout(clones.measures(groups, clones.divergence_stats(classes), clones.violations(classes)))


INSTANCES = "gi AS (SELECT event_id // 2 AS gid, list({'file': user_id % 20, 'line': event_id * 3 % 997, 'end_line': event_id * 3 % 997 + 5} ORDER BY user_id % 20, event_id * 3 % 997) AS s FROM events GROUP BY 1)"


@query(f"""WITH {INSTANCES}, pr AS (SELECT a.gid AS ga, b.gid AS gb, list_zip(a.s, b.s) AS z FROM gi a JOIN gi b ON a.gid < b.gid AND len(a.s) = len(b.s) AND a.s[1].file = b.s[1].file AND a.s[1].line <= b.s[1].end_line + 5 AND b.s[1].line <= a.s[1].end_line + 5),
gp AS (SELECT list_max(list_transform(z, lambda x: greatest(x[2].line - x[1].end_line, x[1].line - x[2].end_line, 0))) AS g FROM pr WHERE len(list_filter(z, lambda x: x[1].file <> x[2].file)) = 0)
SELECT count(*) FILTER (g BETWEEN 1 AND 1) AS gap_1, count(*) FILTER (g BETWEEN 1 AND 2) AS gap_2, count(*) FILTER (g BETWEEN 1 AND 3) AS gap_3, count(*) FILTER (g BETWEEN 1 AND 4) AS gap_4, count(*) FILTER (g BETWEEN 1 AND 5) AS gap_5 FROM gp""")
def stitchable_pairs(spark, d):
    line = F.col("event_id") * 3 % 997
    at = F.struct((F.col("user_id") % 20).alias("file"), line.alias("line"), (line + 5).alias("end_line"))
    return clones.stitchable(t(spark, d, "events").groupBy(F.floor(F.col("event_id") / 2).alias("gid")).agg(F.sort_array(F.collect_list(at)).alias("instances")))


@query("""SELECT a.o_custkey AS block, a.o_orderkey AS "first", b.o_orderkey AS "last", list(x.o_orderstatus ORDER BY x.o_orderkey) AS tokens FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey JOIN orders x ON x.o_custkey = a.o_custkey AND x.o_orderkey BETWEEN a.o_orderkey AND b.o_orderkey GROUP BY ALL""")
def statement_runs(spark, d):
    return clones.statement_runs(t(spark, d, "orders").select(F.col("o_custkey").alias("block"), F.col("o_orderkey").alias("pos"), F.array("o_orderstatus").alias("tokens")))


@query("""WITH m AS (SELECT o_custkey AS gid, CASE WHEN o_custkey % 3 = 0 THEN 'T' ELSE 'T' || (o_orderkey % 2) END AS tr, 'm' || (o_custkey % 2) AS me, CASE WHEN o_custkey % 5 = 0 THEN 'Y' ELSE o_orderstatus END AS ty, [CASE WHEN o_custkey % 4 = 0 THEN 'c' ELSE o_orderstatus END] AS ca, [CASE WHEN o_orderkey % 2 = 0 THEN 'view' ELSE 'x' END] AS ma, o_orderstatus = 'F' AS de FROM orders),
g AS (SELECT gid, count(DISTINCT tr) AS nt, min(tr) AS tr, count(DISTINCT me) AS nm, count(DISTINCT ty) AS ny, min(ty) AS ty, count(DISTINCT array_to_string(ca, ',')) AS nc, count(*) FILTER (de) AS dead, count(*) AS n, bool_or(ma[1] = 'view') AS ui FROM m GROUP BY 1)
SELECT gid, CASE WHEN nt = 1 AND nm = 1 AND tr = 'T' THEN 'default-trait-method' WHEN nc = 1 THEN 'merge-family' WHEN ui THEN 'ui-component' WHEN ny = 1 AND ty = 'Y' THEN 'receiver-method' ELSE 'unclassified' END AS refactoring, dead > 0 AND dead < n AS has_dead_copies FROM g""")
def refactoring_classes(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_custkey")
    m = o.select(
        k.alias("gid"), F.when(k % 3 == 0, "T").otherwise(F.concat(F.lit("T"), (F.col("o_orderkey") % 2).cast("string"))).alias("trait"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("method"), F.when(k % 5 == 0, "Y").otherwise(F.col("o_orderstatus")).alias("first_type"),
        F.array(F.when(k % 4 == 0, "c").otherwise(F.col("o_orderstatus"))).alias("callees"), F.array(F.when(F.col("o_orderkey") % 2 == 0, "view").otherwise("x")).alias("macros"), (F.col("o_orderstatus") == "F").alias("dead"),
    )
    one = spark.range(1)
    return clones.refactoring_class(m, one.select(F.lit("T").alias("name")), one.select(F.lit("Y").alias("name")), ["view"])


@query("""SELECT page_id AS fid, max_by(crate, length(dir)) AS owner FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS f FROM pages) LEFT JOIN (SELECT DISTINCT h AS dir, 'top' || length(h) AS crate FROM (SELECT split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS h FROM pages) UNION ALL SELECT DISTINCT h, 'sub' || length(h) FROM (SELECT regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/]*/[^/]*)/', 1) AS h FROM pages) WHERE h <> '') ON starts_with(f, dir || '/') OR f = dir GROUP BY 1""")
def owning_crates(spark, d):
    bare = t(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("file"))
    top = bare.select(F.substring_index("file", "/", 1).alias("dir")).distinct().select(F.concat(F.lit("top"), F.length("dir").cast("string")).alias("crate"), "dir")
    sub = bare.select(F.regexp_extract("file", "^([^/]*/[^/]*)/", 1).alias("dir")).where("dir <> ''").distinct().select(F.concat(F.lit("sub"), F.length("dir").cast("string")).alias("crate"), "dir")
    return findings.owning_crate(bare.select(F.col("page_id").alias("fid"), "file"), top.unionByName(sub)).select("fid", "owner")


@query("""SELECT o_custkey % 50 AS self_key, 'f' || (o_custkey % 3) AS file, lo, lo + 9 AS hi, list_sort(list_distinct(list(o_orderstatus))) AS items FROM (SELECT *, o_orderkey % 20 AS lo FROM orders WHERE o_orderkey % 20 <> 7) GROUP BY ALL UNION ALL SELECT o_custkey % 50, 'f' || (o_custkey % 3), NULL, NULL, [o_orderstatus] FROM orders WHERE o_orderkey % 20 = 7""")
def merged_blocks(spark, d):
    lo = F.when(F.col("o_orderkey") % 20 != 7, F.col("o_orderkey") % 20)
    b = t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("self_key"), F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("file"), lo.alias("lo"), (lo + 9).alias("hi"), F.array("o_orderstatus").alias("items"))
    return usage.merged_impl_blocks(b).select("self_key", "file", "lo", "hi", "items")


@query("""WITH r AS (SELECT user_id AS f, floor(value)::BIGINT % 100 AS lo, floor(value)::BIGINT % 100 + 3 AS hi FROM events), c AS (SELECT DISTINCT f, unnest(range(lo, hi + 1)) AS line FROM r) SELECT user_id AS file, count(*) FILTER (event_type <> 'view') AS lines FROM events e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.f = e.user_id AND c.line = e.event_id % 100) GROUP BY 1""")
def shipped_lines(spark, d):
    e = t(spark, d, "events")
    v = F.floor("value") % 100
    ranges = e.select(F.col("user_id").alias("file"), v.alias("lo"), (v + 3).alias("hi"))
    return verdicts.shipped_lines(e.select(F.col("user_id").alias("file"), (F.col("event_id") % 100).alias("line"), (F.col("event_type") != "view").alias("is_code")), ranges)


@query("""WITH RECURSIVE en AS (SELECT 'c' || (c_custkey % 40) AS crate, CASE WHEN c_custkey % 9 = 0 THEN 'default' ELSE 'f' || (c_custkey % 13) END AS feature, CASE WHEN c_nationkey % 6 = 0 THEN 'dep:x' WHEN c_nationkey % 7 = 0 THEN 'y/z' ELSE 'f' || c_nationkey END AS entry FROM customer),
cl AS (SELECT DISTINCT crate, 'default' AS feature FROM en WHERE feature = 'default' UNION SELECT cl.crate, en.entry FROM cl JOIN en ON cl.crate = en.crate AND cl.feature = en.feature WHERE NOT starts_with(entry, 'dep:') AND NOT contains(entry, '/')) SELECT crate, feature FROM cl""")
def default_features(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    e = t(spark, d, "customer").select(text("c", k % 40).alias("crate"), F.when(k % 9 == 0, "default").otherwise(text("f", k % 13)).alias("feature"), F.when(n % 6 == 0, "dep:x").when(n % 7 == 0, "y/z").otherwise(text("f", n)).alias("entry"))
    return verdicts.default_features(e)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'deny' WHEN o_orderstatus = 'F' THEN 'deny' ELSE 'warn' END AS level FROM orders WHERE o_orderkey % 4 = 0 OR o_orderstatus <> 'P'""")
def applied_levels(spark, d):
    f = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("lint"), F.when(F.col("o_orderkey") % 4 == 0, "deny").otherwise("warn").alias("level"), (F.col("o_orderkey") % 4 == 0).alias("explicit"))
    lv = spark.createDataFrame([("F", "deny"), ("P", "allow")], "lint string, level string")
    return findings.apply_levels(f, lv).select("o_orderkey", "level")


@query("SELECT event_type AS lint, user_id % 7 AS note, min(event_id) AS pos FROM events GROUP BY ALL")
def notes_once(spark, d):
    return findings.once_notes(t(spark, d, "events").select(F.col("event_type").alias("lint"), (F.col("user_id") % 7).alias("note"), F.col("event_id").alias("pos")))


@query("""SELECT s_name AS tool, CASE WHEN s_suppkey % 5 > 0 THEN '1.' || s_nationkey END AS found, locked FROM supplier JOIN (SELECT n_name, '1.' || min_by(c_nationkey % 3 * 7, c_custkey) AS locked FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) ON n_name = (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) WHERE CASE WHEN s_suppkey % 5 > 0 THEN '1.' || s_nationkey END IS DISTINCT FROM locked""")
def tool_versions(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    out = F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("tool v1."), F.col("s_nationkey").cast("string"))).otherwise("none")
    tools = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("tool"), F.col("n_name").alias("crate"), out.alias("output"))
    lock = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("pos"), F.col("n_name").alias("crate"), F.concat(F.lit("1."), (F.col("c_nationkey") % 3 * 7).cast("string")).alias("version"))
    return verdicts.version_mismatch(tools, lock, "([0-9]+[.][0-9]+)")


@query("""WITH ex AS (SELECT DISTINCT l_suppkey % 7 AS universe, l_partkey % 90 AS name FROM lineitem), pr AS (SELECT DISTINCT p_size % 7 AS universe, p_partkey % 90 AS name FROM part WHERE p_partkey % 6 > 0) SELECT universe, list_sort(list(name)) AS missing FROM ex WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.universe = ex.universe AND pr.name = ex.name) GROUP BY 1""")
def incomplete_universes(spark, d):
    ex = t(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("universe"), (F.col("l_partkey") % 90).alias("name")).distinct()
    pr = t(spark, d, "part").where("p_partkey % 6 > 0").select((F.col("p_size") % 7).cast("long").alias("universe"), (F.col("p_partkey") % 90).alias("name"))
    return verdicts.incomplete_groups(ex, pr)


@query("""SELECT event_type AS name, user_id AS path, ts AS mtime FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, user_id DESC) AS n FROM events) WHERE n = 1""")
def newest_copies(spark, d):
    return verdicts.newest_copy(t(spark, d, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("path"), F.col("ts").alias("mtime")), ["name"])


@query("SELECT DISTINCT user_id AS n FROM events WHERE user_id = 3 OR user_id IN (SELECT DISTINCT user_id FROM events WHERE user_id <> 3 ORDER BY user_id DESC LIMIT 2)")
def kept_generations(spark, d):
    return verdicts.retained_generations(t(spark, d, "events").select(F.col("user_id").alias("n")).distinct(), 3, 2)


@query("SELECT user_id AS name FROM (SELECT user_id, CASE WHEN user_id % 4 > 0 THEN max(ts) END AS m FROM events GROUP BY 1) WHERE user_id <> 5 AND m IS NOT NULL AND epoch((SELECT max(ts) FROM events)) - epoch(m) > 36000")
def stale_caches(spark, d):
    e = t(spark, d, "events")
    c = e.groupBy(F.col("user_id").alias("name")).agg(F.max("ts").alias("m")).select("name", F.when(F.col("name") % 4 > 0, F.col("m")).alias("last_used"))
    now = e.agg(F.max("ts").alias("now"))
    return verdicts.stale_entries(c.crossJoin(F.broadcast(now)), 5, F.col("now"), 36000).select("name")


@query("""WITH f AS (SELECT source AS krate, quality = 0 AS suppressed FROM documents JOIN labels USING (doc_id)) SELECT krate, count(*) FILTER (NOT suppressed) AS visible, count(*) FILTER (suppressed) AS silenced FROM f WHERE krate NOT LIKE '%1' GROUP BY 1 HAVING count(*) FILTER (NOT suppressed) >= 3""")
def publish_hints(spark, d):
    f = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select(F.col("source").alias("krate"), (F.col("quality") == 0).alias("suppressed"))
    return model.publish_hints(f.where("krate is not null"), f.where("krate like '%1'").select("krate"), 3)


DECLS = """de AS (SELECT 's' || s_suppkey AS member, 'n' || n AS name, CASE WHEN s_suppkey % 6 = 0 THEN 'build' WHEN s_suppkey % 6 = 1 THEN 'dev' ELSE 'normal' END AS kind, s_suppkey % 7 = 0 AS optional, s_suppkey % 11 = 0 AS gated, s_nationkey FROM supplier, range(5) t(n)), ed AS (SELECT 'n' || (n_nationkey % 12) AS pkg, 'n' || n_nationkey AS dep FROM nation)"""


@query(f"""WITH RECURSIVE {DECLS}, cl AS (SELECT DISTINCT name AS r, name AS x FROM de UNION SELECT cl.r, ed.dep FROM cl JOIN ed ON cl.x = ed.pkg), us AS (SELECT DISTINCT 's' || s_suppkey AS member, 'n' || s_nationkey AS crate FROM supplier WHERE s_acctbal > 1000), co AS (SELECT 's' || s_suppkey AS member FROM supplier WHERE s_suppkey % 5 > 0)
SELECT member, name, CASE WHEN optional THEN 'optional' WHEN gated THEN 'target-gated' WHEN kind = 'build' THEN 'build' WHEN kind = 'dev' AND substr(member, 2)::INT % 4 > 0 THEN 'dev-without-tests' WHEN member NOT IN (SELECT member FROM co) THEN 'not-compiled'
 WHEN EXISTS (SELECT 1 FROM cl JOIN us ON us.crate = cl.x WHERE cl.r = de.name AND us.member = de.member) OR (name = 'n3' AND substr(member, 2)::INT % 3 = 0) THEN 'used' ELSE 'unused' END AS verdict FROM de""")
def dep_verdicts(spark, d):
    s = t(spark, d, "supplier")
    member = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("member")
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    kind = F.when(F.col("s_suppkey") % 6 == 0, "build").when(F.col("s_suppkey") % 6 == 1, "dev").otherwise("normal")
    decl = s.select(member, F.explode(F.array(*[F.lit(f"n{i}") for i in range(5)])).alias("name"), kind.alias("kind"), (F.col("s_suppkey") % 7 == 0).alias("optional"), (F.col("s_suppkey") % 11 == 0).alias("target_gated"))
    used = s.where("s_acctbal > 1000").select(member, n(F.col("s_nationkey")).alias("crate")).distinct()
    edges = t(spark, d, "nation").select(n(F.col("n_nationkey") % 12).alias("pkg"), n(F.col("n_nationkey")).alias("dep"))
    got = verdicts.dep_verdict(decl, used, s.where("s_suppkey % 3 = 0").select(member, F.lit("n3").alias("crate")), edges, s.where("s_suppkey % 5 > 0").select(member), s.where("s_suppkey % 4 = 0").select(member))
    return got.select("member", "name", "verdict")


@query("""WITH e AS (SELECT c_nationkey AS member, c_mktsegment || '-' || (c_custkey % 30) AS alias, CASE WHEN c_custkey % 4 = 0 THEN 'pkg-' || (c_custkey % 9) END AS package, 'dependencies' AS section, 'normal' AS kind FROM customer),
x AS (SELECT *, replace(coalesce(package, alias), '-', '_') AS name, replace(alias, '-', '_') AS a FROM e), v AS (SELECT DISTINCT c_nationkey AS member, replace(CASE WHEN c_custkey % 4 = 0 THEN 'pkg-' || (c_custkey % 9) ELSE c_mktsegment || '-' || (c_custkey % 30) END, '-', '_') AS name, CASE WHEN c_nationkey % 3 = 0 THEN 'unused' WHEN c_nationkey % 3 = 1 THEN 'not-compiled' ELSE 'used' END AS verdict FROM customer),
c AS (SELECT DISTINCT n_nationkey AS member, unnest(['BUILDING' || (n_nationkey % 30), 'MACHINERY_' || (n_nationkey % 30)]) AS name FROM nation)
SELECT x.member, alias, section, verdict AS status FROM x JOIN v ON x.member = v.member AND x.name = v.name WHERE verdict <> 'used' AND NOT EXISTS (SELECT 1 FROM c WHERE c.member = x.member AND (c.name = x.a OR c.name = replace(x.a, '_', '')))""")
def dep_partition(spark, d):
    c = t(spark, d, "customer")
    alias = F.concat_ws("-", "c_mktsegment", (F.col("c_custkey") % 30).cast("string"))
    package = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("pkg-"), (F.col("c_custkey") % 9).cast("string")))
    e = c.select(F.col("c_nationkey").alias("member"), alias.alias("alias"), package.alias("package"), F.lit("dependencies").alias("section"), F.lit("normal").alias("kind"))
    verdict = F.when(F.col("member") % 3 == 0, "unused").when(F.col("member") % 3 == 1, "not-compiled").otherwise("used")
    v = e.select("member", P.code_name(F.coalesce("package", "alias")).alias("name"), "kind", verdict.alias("verdict")).distinct()
    k = (F.col("n_nationkey") % 30).cast("string")
    credited = t(spark, d, "nation").select(F.col("n_nationkey").alias("member"), F.explode(F.array(F.concat(F.lit("BUILDING"), k), F.concat(F.lit("MACHINERY_"), k))).alias("name"))
    return model.dep_partition(e, v, credited)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'm' || (c_custkey % 60) AS src, 'm' || (c_custkey * 7 % 90) AS dst, CASE c_custkey % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'build' ELSE 'normal' END AS kind, c_custkey % 11 = 0 AS opt FROM customer), i AS (SELECT * FROM e WHERE substr(dst, 2)::INT < 60),
cl AS (SELECT x AS m FROM (VALUES ('m3'), ('m14')) v(x) UNION SELECT dst FROM i WHERE kind = 'dev' AND NOT opt AND src IN ('m3', 'm14') UNION SELECT i.dst FROM cl JOIN i ON cl.m = i.src WHERE kind <> 'dev' AND NOT opt) SELECT m AS member FROM cl""")
def member_closure(spark, d):
    k = F.col("c_custkey")
    m = lambda x: F.concat(F.lit("m"), x.cast("string"))
    e = t(spark, d, "customer").select(m(k % 60).alias("src"), m(k * 7 % 90).alias("dst"), F.when(k % 5 == 0, "dev").when(k % 5 == 1, "build").otherwise("normal").alias("kind"), (k % 11 == 0).alias("optional")).distinct()
    members = spark.range(60).select(m(F.col("id")).alias("member"))
    return verdicts.member_closure(members.where("member in ('m3', 'm14')"), e, members, tests=True, all_features=False)


@query("""WITH RECURSIVE ms AS (SELECT 'm-' || s_suppkey AS m FROM supplier), e AS (SELECT DISTINCT 'm-' || l_suppkey AS s, 'm-' || (l_suppkey + 1 + l_linenumber % 2 * 3) AS d FROM lineitem WHERE l_suppkey % 4 > 0), cl AS (SELECT m AS r, m AS x FROM ms UNION SELECT cl.r, e.d FROM cl JOIN e ON cl.x = e.s WHERE e.d IN (SELECT m FROM ms)) SELECT replace(x, '-', '_') AS krate, replace(r, '-', '_') AS member FROM cl""")
def crate_dependents(spark, d):
    m = lambda x: F.concat(F.lit("m-"), x.cast("string"))
    deps = t(spark, d, "lineitem").where("l_suppkey % 4 > 0").select(m(F.col("l_suppkey")).alias("member"), m(F.col("l_suppkey") + 1 + F.col("l_linenumber") % 2 * 3).alias("name")).distinct()
    return shadow.dependents(t(spark, d, "supplier").select(m(F.col("s_suppkey")).alias("member")), deps)


@query("""WITH c AS (SELECT DISTINCT string_split(text, ' ')[2] AS name, 'k' || (item_id % 3) AS krate FROM benchmark WHERE regexp_matches(string_split(text, ' ')[2], '^[a-z]+$')), r AS (SELECT doc_id AS rid, 'k' || (doc_id % 3) AS krate, text FROM documents WHERE lang = 'en')
SELECT c.krate || '::' || name AS path, min(rid) AS rid FROM c JOIN r ON c.krate = r.krate AND regexp_matches(r.text, '(^|[^\\p{L}\\p{N}_])' || c.name || '($|[^\\p{L}\\p{N}_])') GROUP BY 1""")
def region_mentions(spark, d):
    b = t(spark, d, "benchmark").select(F.get(F.split("text", " "), F.lit(1)).alias("name"), F.concat(F.lit("k"), (F.col("item_id") % 3).cast("string")).alias("krate")).where("name rlike '^[a-z]+$'").distinct()
    c = b.select(F.concat_ws("::", "krate", "name").alias("path"), "krate", F.lit(None).cast("string").alias("parent"), "name")
    r = t(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("rid"), F.concat(F.lit("k"), (F.col("doc_id") % 3).cast("string")).alias("krate"), "text")
    return shadow.mentions(c, r, spark.range(3).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("krate")).withColumn("member", F.col("krate")))


@query("""WITH a AS (SELECT event_id AS id, user_id AS file, floor(epoch(ts))::BIGINT AS lo, floor(epoch(ts))::BIGINT + 600 AS hi FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS rid, user_id AS file, floor(epoch(ts))::BIGINT AS lo, floor(epoch(ts))::BIGINT + 900 AS hi FROM events WHERE event_type = 'view') SELECT id, min(rid) AS rid FROM a JOIN r ON a.file = r.file AND r.lo < a.hi AND a.lo < r.hi GROUP BY 1""")
def overlapping_regions(spark, d):
    e, at = t(spark, d, "events"), F.unix_timestamp("ts")
    some = lambda kind, name, width: e.where(F.col("event_type") == kind).select(F.col("event_id").alias(name), F.col("user_id").alias("file"), at.alias("lo"), (at + width).alias("hi"))
    return shadow.overlapping(some("purchase", "id", 600), some("view", "rid", 900))


@query("""WITH k AS (SELECT DISTINCT p_name AS n FROM part), o AS (SELECT DISTINCT replace(p_name, 'e', 'ea') AS name FROM part WHERE replace(p_name, 'e', 'ea') NOT IN (SELECT n FROM k)) SELECT name, (SELECT n FROM k WHERE levenshtein(n, o.name) <= 3 ORDER BY levenshtein(n, o.name), n LIMIT 1) AS suggestion FROM o""")
def unknown_names(spark, d):
    p = t(spark, d, "part").select("p_name").distinct()
    return findings.unknown(p.select(F.replace("p_name", F.lit("e"), F.lit("ea")).alias("name")).distinct(), p.select(F.col("p_name").alias("name")))


@query("""WITH f AS (SELECT 'src/' || source || '/' || doc_id AS path, 'r' || (doc_id % 700) AS real_path, CASE WHEN doc_id % 9 = 0 THEN 'test' ELSE 'lib' END AS target_kind FROM documents), g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY real_path ORDER BY path, target_kind) AS n FROM f WHERE target_kind <> 'test') WHERE n = 1) SELECT path FROM g WHERE path LIKE 'src/src%' AND path NOT LIKE 'src/src1/%'""")
def scanned_files(spark, d):
    f = t(spark, d, "documents").where("source is not null").select(F.concat_ws("/", F.lit("src"), "source", F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("r"), (F.col("doc_id") % 700).cast("string")).alias("real_path"), F.when(F.col("doc_id") % 9 == 0, "test").otherwise("lib").alias("target_kind"))
    return clones.scan_files(f, ["src/src*/*"], ["src/src1/*"]).select("path")


@query("""WITH e AS (SELECT doc_id, 'd' || doc_id AS path, substr(text, 1, 4) AS now, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 4) ELSE 'zzzz' END AS r FROM documents WHERE regexp_matches(text, '^[ -~]{5}')) SELECT path, 0 AS lo, 4 AS hi, r AS replacement FROM e WHERE now <> r AND doc_id % 5 > 0""")
def wanted_edits(spark, d):
    x = t(spark, d, "documents").where("text rlike '^[ -~]{5}'").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    e = x.select("path", F.lit(0).alias("lo"), F.lit(4).alias("hi"), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 4)).otherwise("zzzz").alias("replacement"))
    return findings.tracked_edits(findings.needed_edits(x.select("path", F.col("text").alias("content")), e), x.where("doc_id % 5 > 0").select("path"))


@query("SELECT doc_id, 'a/' || source AS file FROM documents WHERE source IS NULL OR source NOT LIKE '%7'")
def authored_findings(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.concat(F.lit("a/"), "source").alias("file"))
    return findings.drop_generated(x, x.where("file like '%7'").select(F.replace("file", F.lit("/"), F.lit("\\")).alias("path")))


@query("""SELECT event_id, line_lo FROM (SELECT p.event_id, s.line_lo, row_number() OVER (PARTITION BY p.event_id ORDER BY s.line_lo DESC, s.col_lo DESC, s.line_hi DESC) AS n FROM (SELECT event_id, user_id, event_id % 300 AS l, event_id % 7 AS c FROM events WHERE event_type = 'purchase') p JOIN (SELECT user_id, event_id * 7 % 300 AS line_lo, event_id % 5 AS col_lo, event_id * 7 % 300 + 20 AS line_hi, 3 AS col_hi FROM events) s ON p.user_id = s.user_id AND (s.line_lo, s.col_lo) <= (p.l, p.c) AND (p.l, p.c) <= (s.line_hi, s.col_hi)) WHERE n = 1""")
def enclosing_function(spark, d):
    e, k = t(spark, d, "events"), F.col("event_id")
    spans = e.select("user_id", (k * 7 % 300).alias("line_lo"), (k % 5).alias("col_lo"), (k * 7 % 300 + 20).alias("line_hi"), F.lit(3).cast("long").alias("col_hi"))
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", (k % 300).alias("l"), (k % 7).alias("c"))
    return graph.innermost_by_start(p, spans, "user_id", "l", "c").select("event_id", "line_lo")


@query("""SELECT doc_id, 'clone at ' || CASE WHEN doc_id % 2 = 0 THEN 'tessera_lint::expect!(' || replace(l, '-', '_') || ');' WHEN doc_id % 3 = 0 THEN '# tessera-lint: expect(' || l || ')' ELSE '// tessera-lint: expect(' || l || ')' END AS hint FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'file-size' ELSE 'unused-pub' END AS l FROM documents)""")
def silence_hints(spark, d):
    k = F.col("doc_id")
    lint = F.when(k % 5 == 0, "file-size").otherwise("unused-pub")
    file = F.when((k % 2 == 0) | (k % 3 > 0), "src/a.rs").otherwise("Cargo.toml")
    return t(spark, d, "documents").select("doc_id", F.concat(F.lit("clone at "), P.silence_hint(file, F.lit("line"), k % 2 == 0, lint)).alias("hint"))
