"""Queries of the semantic model, the call graph and the guards over stand-in facts, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import callgraph, guards, imports, model, scaffold, usage
from ..operators.graph import cut
from . import facts
from .queries import query

CAT = "CASE WHEN parent_kind IS NULL OR parent_kind = 'mod' THEN 'module' WHEN parent_kind = 'impl' AND trait_item IS NOT NULL THEN 'trait-impl' WHEN parent_kind = 'impl' THEN 'inherent' ELSE 'other' END"
KINDS = "('fn', 'struct', 'enum', 'trait', 'type', 'const', 'static', 'macro', 'union')"
TEST = "(target_kind = 'test' OR is_test_cfg)"
OWN = "coalesce(own_key = to_key, false)"
UP = "regexp_extract({0}, '^(.*)::[^:]*$', 1)"
PREFIXES = "list_transform(range(1, len(string_split({0}, '::')) + 1), lambda n: array_to_string(string_split({0}, '::')[1:n], '::'))"
D, E = facts.defs_sql(), facts.edges_sql()
LAND = "l AS (SELECT e.*, k.key, k.trait_item FROM e LEFT JOIN (SELECT cfg, key, trait_item FROM d) k ON e.cfg = k.cfg AND e.to_key = k.key)"
TP = f"tp AS (SELECT m.cfg, m.key, t.trait_key FROM d m JOIN (SELECT cfg, path, min(key) AS trait_key FROM d GROUP BY ALL) t ON m.cfg = t.cfg AND {UP.format('m.path')} = t.path WHERE m.parent_kind = 'trait')"
USES = f"""u0 AS (SELECT cfg, key, coalesce(trait_item, key) AS m, external, {TEST} AS test, from_key, from_path FROM l WHERE key IS NOT NULL AND NOT trait_scope AND NOT import AND NOT {OWN}),
u AS (SELECT cfg, key, external, test FROM u0 UNION ALL SELECT u0.cfg, tp.trait_key, external, test FROM u0 JOIN tp ON u0.cfg = tp.cfg AND u0.m = tp.key)"""
FOLD = "g AS (SELECT cfg, key, count(*) AS total, count(*) FILTER (NOT external) AS intra, count(*) FILTER (test) AS test, count(*) FILTER (test AND NOT external) AS test_intra FROM u GROUP BY ALL)"
MODEL = f"{D}, {E}, {LAND}, {TP}, {USES}, {FOLD}"
REACH = """r AS (SELECT d.*, CASE WHEN export_root THEN 'export-root' WHEN g.key IS NOT NULL THEN 'direct' WHEN trait_item IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d x WHERE x.cfg = d.cfg AND x.key = d.trait_item) THEN 'external-dispatch'
 WHEN trait_item IS NOT NULL AND EXISTS (SELECT 1 FROM g y WHERE y.cfg = d.cfg AND y.key = d.trait_item) THEN 'internal-dispatch' ELSE 'unreached' END AS reach FROM d LEFT JOIN g ON d.cfg = g.cfg AND d.key = g.key)"""
HOP = f"""mods AS (SELECT cfg, path AS m, max_by(public, key) AS v FROM d WHERE kind = 'mod' GROUP BY ALL), px AS (SELECT DISTINCT cfg, p FROM (SELECT cfg, path AS p FROM d UNION ALL SELECT cfg, from_path FROM l)),
hop AS (SELECT px.cfg, px.p, bool_and(coalesce(v, true)) AS open FROM (SELECT cfg, p, unnest({PREFIXES.format('p')}) AS m FROM px) px LEFT JOIN mods ON px.cfg = mods.cfg AND px.m = mods.m AND contains(px.m, '::') GROUP BY ALL)"""
REX = f"""rx0 AS (SELECT cfg, key, from_path AS module, bool_or("glob") AS "glob" FROM l WHERE key IS NOT NULL AND import AND reexport AND NOT trait_scope GROUP BY ALL),
rxm AS (SELECT rx0.cfg, d.path, rx0.module, bool_or("glob") OVER (PARTITION BY rx0.cfg, d.path) AS "glob" FROM rx0 JOIN d ON rx0.cfg = d.cfg AND rx0.key = d.key WHERE d.kind = 'mod'),
rx AS (SELECT cfg, key, module, bool_or("glob") AS "glob" FROM (SELECT * FROM rx0 UNION ALL SELECT rxm.cfg, d.key, rxm.module, rxm."glob" FROM rxm JOIN d ON rxm.cfg = d.cfg AND {UP.format('d.path')} = rxm.path AND d.public) GROUP BY ALL)"""
EXT = f"""own AS (SELECT d.cfg, d.key, d.self_type, d.public, {CAT} = 'inherent' AS inh, d.public AND (hop.open OR EXISTS (SELECT 1 FROM rx JOIN hop h ON rx.cfg = h.cfg AND rx.module = h.p WHERE rx.cfg = d.cfg AND rx.key = d.key AND h.open)) AS ok FROM d JOIN hop ON d.cfg = hop.cfg AND d.path = hop.p),
ext AS (SELECT o.cfg, o.key, CASE WHEN o.inh THEN o.public AND coalesce(t.ok AND NOT t.inh, false) ELSE o.ok END AS reachable FROM own o LEFT JOIN own t ON o.cfg = t.cfg AND o.self_type = t.key)"""
FRAG = "fr AS (SELECT DISTINCT cfg, krate, target_kind FROM e)"


def land(spark, d, *more):
    e = facts.edges(spark, d, "cfg", "krate", "target_kind", "is_test_cfg", "from_key", "from_path", "to_key", "to_path", "to_kind", "external", "import", "reexport", "glob", "trait_scope", "in_signature", "own_key", *more)
    return model.landed(e, facts.defs(spark, d, "cfg", "key", "trait_item", "krate"))


def folded(spark, d, x):
    """The fold of all uses, written once for all who read it; edges without the texts that it doesn't look at."""
    e = facts.edges(spark, d, "cfg", "target_kind", "is_test_cfg", "from_key", "to_key", "external", "import", "trait_scope", "own_key")
    return cut(model.fold(model.landed(e, facts.defs(spark, d, "cfg", "key", "trait_item", "krate")), x))


@query(f"WITH {D} SELECT cfg, key, {CAT} AS category, {CAT} IN ('module', 'inherent') AS deletable, public AND NOT synthetic AND {CAT} <> 'other' AND kind IN {KINDS} AS candidate FROM d")
def categories(spark, d):
    x = facts.defs(spark, d)
    cat = model.category(F.col("parent_kind"), F.col("trait_item"))
    return x.select("cfg", "key", cat.alias("category"), model.supports_deletion(cat).alias("deletable"), model.is_candidate(cat).alias("candidate"))


@query(f"WITH {E} SELECT cfg, krate FROM e WHERE target_kind NOT IN ('build', 'test', 'bench', 'example') GROUP BY ALL")
def candidate_crates(spark, d):
    return model.candidate_crates(facts.edges(spark, d, "cfg", "krate", "target_kind"))


@query(f"WITH {MODEL} SELECT cfg, key, total, intra, test, test_intra FROM g")
def use_fold(spark, d):
    return folded(spark, d, facts.defs(spark, d))


@query(f"WITH {MODEL}, {REACH} SELECT cfg, key, reach FROM r")
def reach_of_definitions(spark, d):
    x = facts.defs(spark, d)
    return model.reach(x, folded(spark, d, x)).select("cfg", "key", "reach")


@query(f"WITH {MODEL}, {REACH} SELECT cfg, path, bool_or(reach <> 'unreached') AS reached FROM r WHERE public AND NOT synthetic AND {CAT} <> 'other' AND kind IN {KINDS} GROUP BY ALL")
def candidate_identities(spark, d):
    x = facts.defs(spark, d)
    return model.candidate_identities(model.reach(x, folded(spark, d, x)))


@query(f"""WITH {D}, {E}, {LAND}, {TP} SELECT DISTINCT l.cfg, l.key FROM l WHERE key IS NOT NULL AND in_signature AND NOT trait_scope AND NOT {OWN} AND (EXISTS (SELECT 1 FROM d WHERE d.cfg = l.cfg AND d.key = l.from_key AND d.public)
 OR EXISTS (SELECT 1 FROM tp JOIN d ON tp.cfg = d.cfg AND tp.trait_key = d.key WHERE tp.cfg = l.cfg AND tp.key = l.from_key AND d.public))""")
def signature_exposed(spark, d):
    return model.signature_exposed(land(spark, d), facts.defs(spark, d))


@query(f"WITH {D}, {E}, {LAND}, {REX} SELECT cfg, key, module, \"glob\" FROM rx")
def glob_reexports(spark, d):
    return model.reexported(land(spark, d), facts.defs(spark, d))


@query(f"WITH {D}, {E}, {LAND}, {HOP} SELECT d.cfg, d.key, hop.open FROM d JOIN hop ON d.cfg = hop.cfg AND d.path = hop.p")
def module_visibility(spark, d):
    x = facts.defs(spark, d)
    return x.join(model.module_hop(x, x), ["cfg", "path"]).select("cfg", "key", "open")


@query(f"WITH {D}, {E}, {LAND}, {HOP}, {REX}, {EXT} SELECT cfg, key, reachable FROM ext")
def external_reach(spark, d):
    x = facts.defs(spark, d)
    return model.externally_reachable(x, model.reexported(land(spark, d), x))


@query(f"""WITH {D}, {E}, {LAND} SELECT DISTINCT cfg, key, kind, CASE WHEN kind <> 'own-unit-tests' THEN krate END AS krate FROM (SELECT l.cfg, l.key, l.krate, CASE WHEN target_kind = 'test' THEN 'test-target' WHEN NOT external THEN 'own-unit-tests' WHEN target_kind = 'bin' THEN 'bin-unit-tests' ELSE 'unit-tests' END AS kind
 FROM l WHERE key IS NOT NULL AND NOT trait_scope AND {TEST} AND (import OR NOT {OWN}) AND NOT EXISTS (SELECT 1 FROM d WHERE d.cfg = l.cfg AND d.key = l.from_key AND d.synthetic))""")
def test_users(spark, d):
    return model.test_users(land(spark, d), facts.defs(spark, d))


USAGE = f"""hm AS (SELECT krate, min(cfg) AS home FROM fr WHERE target_kind NOT IN ('build', 'test', 'bench', 'example') GROUP BY 1),
sx AS (SELECT DISTINCT l.cfg, l.key FROM l WHERE key IS NOT NULL AND in_signature AND NOT trait_scope AND NOT {OWN} AND (EXISTS (SELECT 1 FROM d WHERE d.cfg = l.cfg AND d.key = l.from_key AND d.public) OR EXISTS (SELECT 1 FROM tp JOIN d ON tp.cfg = d.cfg AND tp.trait_key = d.key WHERE tp.cfg = l.cfg AND tp.key = l.from_key AND d.public))),
it AS (SELECT DISTINCT cfg, key FROM l WHERE key IS NOT NULL AND import AND reexport AND NOT trait_scope),
c AS (SELECT r.*, hm.home, coalesce(total, 0) AS a, coalesce(intra, 0) AS b, coalesce(test, 0) AS t, coalesce(test_intra, 0) AS ti, sx.key IS NOT NULL AS s, it.key IS NOT NULL AS x, ext.reachable FROM r JOIN hm USING (krate) LEFT JOIN g ON r.cfg = g.cfg AND r.key = g.key
 LEFT JOIN sx ON r.cfg = sx.cfg AND r.key = sx.key LEFT JOIN it ON r.cfg = it.cfg AND r.key = it.key JOIN ext ON r.cfg = ext.cfg AND r.key = ext.key WHERE public AND NOT synthetic AND {CAT} <> 'other' AND kind IN {KINDS} AND NOT from_expansion),
f AS (SELECT path, bool_or(a > b) AS cross_, bool_or(b > 0) AS intra_, bool_or(a - b > t - ti) AS pc, bool_or(b > ti) AS pi, bool_or(b > 0 AND cfg = home) AS ih, bool_or(reach IN ('external-dispatch', 'internal-dispatch', 'export-root')) AS disp, bool_or(s) AS s, bool_or(x) AS x, bool_or(reachable) AS er FROM c GROUP BY path),
far AS (SELECT path, bool_or(external) AS c, bool_or(NOT external) AS i, bool_or(external AND NOT {TEST}) AS pc, bool_or(NOT external AND NOT {TEST}) AS pi FROM (SELECT l.*, ix.path FROM l JOIN (SELECT key, min_by(path, cfg) AS path FROM d GROUP BY key) ix ON l.to_key = ix.key WHERE l.key IS NULL) WHERE NOT trait_scope AND NOT import AND NOT {OWN} GROUP BY path),
h AS (SELECT f.path, s, x, er, ih, disp, cross_ OR coalesce(far.c, false) AS c, intra_ OR coalesce(far.i, false) AS i, f.pc OR coalesce(far.pc, false) AS pc, f.pi OR coalesce(far.pi, false) AS pi FROM f LEFT JOIN far ON f.path = far.path)
SELECT path, CASE WHEN pc OR (c AND pi) THEN 'CrossCrate' WHEN disp THEN 'DispatchReached' WHEN pi THEN 'IntraCrate' WHEN c OR i THEN 'TestOnly' ELSE 'Unused' END AS usage, s AS signature_exposed, er AS externally_reachable, x AS reexport_target, i AND NOT ih AND NOT c AS intra_off_home FROM h"""


@query(f"WITH {MODEL}, {REACH}, {HOP}, {REX}, {EXT}, {FRAG}, {USAGE}")
def pub_usage(spark, d):
    x = facts.defs(spark, d)
    index = usage.identity_index(x, ordinal="cfg")
    return model.pub_usage(x, land(spark, d), facts.edges(spark, d, "cfg", "krate", "target_kind").distinct(), index)


GONE = "rm AS (SELECT DISTINCT path FROM d WHERE p_mod)"
REMOVED = "rm AS (SELECT DISTINCT path FROM d WHERE key % 200 IN (2, 15, 16, 25, 40, 41, 52, 66, 75, 99))"
EGONE = f"""lg AS (SELECT l.*, (SELECT count(*) FROM rm WHERE rm.path = l.from_path OR starts_with(l.from_path, rm.path || '::')) > 0 OR coalesce(own.path IN (SELECT path FROM rm), false) AS gone FROM l LEFT JOIN (SELECT cfg, key AS k, path FROM d) own ON l.cfg = own.cfg AND l.own_key = own.k)"""


def removed(spark, d):
    return facts.defs(spark, d, "key", "path").where("key % 200 IN (2, 15, 16, 25, 40, 41, 52, 66, 75, 99)").select("path").distinct()


@query(f"WITH {D}, {E}, {LAND}, {REMOVED}, {EGONE} SELECT cfg, gone, count(*) AS n FROM lg GROUP BY ALL")
def removed_edges(spark, d):
    return model.edge_removed(land(spark, d), removed(spark, d), facts.defs(spark, d)).groupBy("cfg", "gone").agg(F.count("*").alias("n"))


@query(f"""WITH {D}, {E}, {LAND}, {TP}, {REMOVED}, {EGONE}, u0 AS (SELECT cfg, key, coalesce(trait_item, key) AS m, external, {TEST} AS test FROM lg WHERE NOT gone AND key IS NOT NULL AND NOT trait_scope AND NOT import AND NOT {OWN}),
u AS (SELECT cfg, key, external, test FROM u0 UNION ALL SELECT u0.cfg, tp.trait_key, external, test FROM u0 JOIN tp ON u0.cfg = tp.cfg AND u0.m = tp.key), {FOLD} SELECT cfg, key, total, intra, test, test_intra FROM g""")
def refold_excluding(spark, d):
    x = facts.defs(spark, d)
    return usage.degrees(model.uses_without(land(spark, d), x, removed(spark, d)), ["cfg", "key"])


@query(f"""WITH {D}, {E}, x AS (SELECT e.cfg, e.krate, e.from_path, coalesce(d.path, e.to_path) AS target, e.to_kind, e.import, e."glob", e.file, e.lo FROM e LEFT JOIN d ON e.cfg = d.cfg AND e.to_key = d.key WHERE e.target_kind NOT IN ('test', 'build') AND NOT in_signature AND NOT trait_scope),
p AS (SELECT DISTINCT cfg, from_path FROM x), b AS (SELECT p.cfg, p.from_path, max_by(m, length(m)) AS m FROM (SELECT cfg, from_path, unnest({PREFIXES.format('from_path')}) AS m FROM p) p JOIN (SELECT DISTINCT cfg, path FROM d WHERE kind = 'mod') k ON p.cfg = k.cfg AND p.m = k.path GROUP BY ALL)
SELECT x.cfg, krate, coalesce(m, split_part(x.from_path, '::', 1)) AS module, target, to_kind, import, "glob", count(*) AS n FROM x LEFT JOIN b ON x.cfg = b.cfg AND x.from_path = b.from_path GROUP BY ALL""")
def references_from(spark, d):
    r = model.references_from(facts.edges(spark, d), facts.defs(spark, d, "cfg", "key", "path", "kind"))
    return r.groupBy("cfg", "krate", "module", "target", "to_kind", "import", "glob").agg(F.count("*").alias("n"))


OWNERS = "ow AS (SELECT 'c' || i AS krate, 'owner' || (i % 3) AS owner FROM range(5) t(i))"


def owners(spark):
    return spark.range(5).selectExpr("concat('c', id) AS krate", "concat('owner', id % 3) AS owner")


@query(f"WITH {E}, {OWNERS} SELECT DISTINCT owner, crate FROM (SELECT owner, unnest([split_part(to_path, '::', 1), via]) AS crate FROM e JOIN ow USING (krate) WHERE NOT trait_scope) WHERE crate IS NOT NULL AND crate <> owner")
def exercised_crates(spark, d):
    return model.exercised(None, facts.edges(spark, d, "krate", "to_path", "via", "trait_scope"), owners(spark))


@query(f"""WITH {E}, {OWNERS} SELECT DISTINCT owner, 'compiled' AS what, NULL AS crate FROM e JOIN ow USING (krate) UNION ALL SELECT DISTINCT owner, 'resolver', via FROM e JOIN ow USING (krate) WHERE via <> owner""")
def compiled_and_resolved(spark, d):
    e = facts.edges(spark, d, "krate", "via")
    a = model.compiled_members(e, owners(spark)).select("owner", F.lit("compiled").alias("what"), F.lit(None).cast("string").alias("crate"))
    b = model.resolver_used(e.select("krate", F.col("via").alias("value")), owners(spark)).select("owner", F.lit("resolver").alias("what"), "crate")
    return a.unionByName(b)


@query(f"""WITH {D}, {E}, {LAND}, {REMOVED}, i AS (SELECT l.*, coalesce(d.path, ix.path) AS identity FROM l LEFT JOIN d ON l.cfg = d.cfg AND l.key = d.key LEFT JOIN (SELECT key AS k, min_by(path, cfg) AS path FROM d GROUP BY 1) ix ON l.to_key = ix.k)
SELECT DISTINCT rm.path, coalesce(identity, to_path) AS target, to_kind AS kind, identity IS NOT NULL AS resolved FROM i JOIN rm ON i.from_path = rm.path OR starts_with(i.from_path, rm.path || '::') WHERE to_kind <> 'param' AND NOT import AND NOT trait_scope""")
def callees_of(spark, d):
    return callgraph.callees(identified(spark, d), removed(spark, d))


def identified(spark, d, *more):
    x = facts.defs(spark, d, "cfg", "key", "path")
    return callgraph.target_identity(land(spark, d, "file", "lo", *more), x, usage.identity_index(x, ordinal="cfg"))


IDENT = "i AS (SELECT l.*, coalesce(k.path, ix.path) AS identity FROM l LEFT JOIN (SELECT cfg, key AS k, path FROM d) k ON l.cfg = k.cfg AND l.key = k.k LEFT JOIN (SELECT key AS k, min_by(path, cfg) AS path FROM d GROUP BY 1) ix ON l.to_key = ix.k)"


@query(f"WITH {D}, {E}, {LAND}, {REMOVED}, {IDENT} SELECT DISTINCT identity AS path, from_path, file, lo, import, in_signature FROM i WHERE identity IN (SELECT path FROM rm)")
def references_to(spark, d):
    return callgraph.references_to(identified(spark, d), removed(spark, d))


@query(f"WITH {D}, {E}, {LAND}, {IDENT} SELECT from_path AS caller, identity AS callee, count(*) AS n FROM i WHERE to_kind <> 'param' AND NOT import AND NOT trait_scope AND identity IS NOT NULL GROUP BY ALL")
def call_graph(spark, d):
    return callgraph.call_edges(identified(spark, d))


@query(f"""WITH {D}, f AS (SELECT d.*, m.path AS trait_method FROM d LEFT JOIN d m ON d.cfg = m.cfg AND d.trait_item = m.key WHERE d.kind = 'fn' AND d.lo IS NOT NULL AND NOT d.from_expansion)
SELECT file, path, krate, lo, hi, trait_method FROM (SELECT *, row_number() OVER (PARTITION BY file, path ORDER BY cfg, key) AS n FROM f) WHERE n = 1""")
def functions_by_file(spark, d):
    return callgraph.functions_by_file(facts.defs(spark, d))


@query("""WITH m AS (SELECT source AS gid, 'd' || doc_id AS path FROM documents), b AS (SELECT 'd' || doc_id AS path, 'd' || (doc_id * 7 % 1000) AS from_path FROM labels),
s AS (SELECT m.gid, m.path, count(b.from_path) FILTER (x.path IS NULL) AS n FROM m LEFT JOIN b ON m.path = b.path LEFT JOIN m x ON x.gid IS NOT DISTINCT FROM m.gid AND x.path = b.from_path GROUP BY ALL)
SELECT gid, path FROM s WHERE n = 0 AND gid IN (SELECT gid FROM s WHERE n > 0)""")
def dead_copies(spark, d):
    m = spark.read.parquet(f"{d}/documents.parquet").selectExpr("source AS gid", "concat('d', doc_id) AS path")
    return callgraph.dead_copies(m, spark.read.parquet(f"{d}/labels.parquet").selectExpr("concat('d', doc_id) AS path", "concat('d', doc_id * 7 % 1000) AS from_path"))


ASSOC = "am AS (SELECT d.cfg, coalesce(self_type, tp.trait_key) AS owner, d.key FROM d LEFT JOIN tp ON d.cfg = tp.cfg AND d.key = tp.key WHERE kind = 'fn' AND coalesce(self_type, tp.trait_key) IS NOT NULL)"
AT = "at_ AS (SELECT cfg, path AS p, min_by({'key': key, 'kind': kind}, key) AS x FROM d GROUP BY ALL)"
LANDINGS = f"""{AT}, fl AS (SELECT d.cfg, CASE WHEN a1.x IS NULL OR a1.x.kind = 'variant' THEN a2.x.key ELSE a1.x.key END AS owner, d.key, split_part(d.path, '::', -1) AS name FROM d LEFT JOIN at_ a1 ON d.cfg = a1.cfg AND {UP.format('d.path')} = a1.p LEFT JOIN at_ a2 ON d.cfg = a2.cfg AND {UP.format(UP.format('d.path'))} = a2.p WHERE d.kind = 'field'),
vl AS (SELECT d.cfg, a1.x.key AS owner, d.key, split_part(d.path, '::', -1) AS name FROM d JOIN at_ a1 ON d.cfg = a1.cfg AND {UP.format('d.path')} = a1.p WHERE d.kind = 'variant'), ld AS (SELECT *, 'field' AS kind FROM fl WHERE owner IS NOT NULL UNION ALL SELECT *, 'variant' FROM vl WHERE owner IS NOT NULL)"""


@query(f"WITH {D}, {TP}, {ASSOC} SELECT cfg, owner, key FROM am")
def assoc_members(spark, d):
    return guards.assoc_members(facts.defs(spark, d))


@query(f"WITH {D}, {LANDINGS} SELECT cfg, owner, key, name, kind FROM ld")
def landings(spark, d):
    x = facts.defs(spark, d)
    return guards.landings(x, "field").withColumn("kind", F.lit("field")).unionByName(guards.landings(x, "variant").withColumn("kind", F.lit("variant")))


@query(f"""WITH {MODEL}, {ASSOC}, {LANDINGS}, x AS (SELECT cfg, trait_key AS owner, key, 'trait' AS what FROM tp UNION ALL SELECT am.cfg, am.owner, am.key, 'inherent' FROM am JOIN d ON am.cfg = d.cfg AND am.owner = d.key AND d.kind IN ('struct', 'enum', 'union') UNION ALL SELECT cfg, owner, key, 'field' FROM ld WHERE kind = 'field')
SELECT x.what, x.cfg, x.owner, bool_or(g.key IS NULL) AS unreached FROM x LEFT JOIN g ON x.cfg = g.cfg AND x.key = g.key GROUP BY ALL""")
def unreached_members(spark, d):
    x = facts.defs(spark, d)
    deg = folded(spark, d, x)
    some = (("trait", guards.trait_members(x)), ("inherent", guards.inherent_members(x)), ("field", guards.landings(x, "field").drop("name")))
    out = [guards.any_unreached(m, deg).select(F.lit(n).alias("what"), "cfg", "owner", "unreached") for n, m in some]
    return out[0].unionByName(out[1]).unionByName(out[2])


MOST = "rm AS (SELECT DISTINCT path FROM d WHERE key % 10 NOT IN (0, 2))"


@query(f"""WITH {MODEL}, {MOST}, {EGONE}, {LANDINGS}, k AS (SELECT DISTINCT s.cfg, s.key FROM (SELECT cfg, key, coalesce(trait_item, key) AS m FROM lg WHERE NOT gone AND key IS NOT NULL AND NOT trait_scope AND NOT import AND NOT {OWN}) s),
hm AS (SELECT krate, min(cfg) AS home FROM e WHERE target_kind NOT IN ('build', 'test', 'bench', 'example') GROUP BY 1)
SELECT DISTINCT lg.from_path AS source, o.path AS owner, ld.name, ld.kind FROM lg JOIN ld ON lg.cfg = ld.cfg AND lg.key = ld.key JOIN d f ON lg.cfg = f.cfg AND lg.key = f.key JOIN d o ON ld.cfg = o.cfg AND ld.owner = o.key JOIN hm ON o.krate = hm.krate AND hm.home = lg.cfg
WHERE gone AND NOT import AND NOT (f.public AND o.public) AND o.path NOT IN (SELECT path FROM rm) AND NOT EXISTS (SELECT 1 FROM k WHERE k.cfg = lg.cfg AND k.key = lg.key)""")
def unmasked_landings(spark, d):
    x = facts.defs(spark, d)
    rm = x.where("key % 10 NOT IN (0, 2)").select("path").distinct()
    e = model.edge_removed(land(spark, d), rm, x)
    home = model.candidate_crates(facts.edges(spark, d, "cfg", "krate", "target_kind")).groupBy("krate").agg(F.min("cfg").alias("home"))
    after = usage.degrees(model.uses(e.where("not gone"), x), ["cfg", "key"])
    return guards.unmasked(e.where("gone").drop("krate"), x, after, rm, home)


@query(f"""WITH {D}, {TP}, {ASSOC}, rm AS (SELECT DISTINCT path FROM d WHERE key % 10 = 6), x AS (SELECT d.*, am.owner FROM d LEFT JOIN am ON d.cfg = am.cfg AND d.key = am.key),
em AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY path ORDER BY cfg) AS n FROM x WHERE path IN (SELECT path FROM rm) AND split_part(path, '::', -1) = 'is_empty') WHERE n = 1 AND kind = 'fn' AND public)
SELECT em.path, o.path AS owner FROM em JOIN d o ON em.cfg = o.cfg AND em.owner = o.key WHERE o.path NOT IN (SELECT path FROM rm) AND EXISTS (SELECT 1 FROM x WHERE x.cfg = em.cfg AND x.owner = em.owner AND x.public AND x.self_kind = 'ref' AND split_part(x.path, '::', -1) = 'len' AND x.path NOT IN (SELECT path FROM rm))""")
def len_without_is_empty(spark, d):
    x = facts.defs(spark, d)
    return guards.len_without_is_empty(x, x.where("key % 10 = 6").select("path").distinct())


BLOCKS = f"bl AS (SELECT {facts.path('p_partkey')} AS self_type, p_size % 3 = 0 AS of_trait, CASE WHEN p_size > 45 THEN NULL ELSE p_partkey * 10 END AS lo, p_partkey * 10 + 5 AS hi, 'f' AS file, CASE WHEN p_size % 5 = 0 THEN [] ELSE [{facts.path('(p_partkey + 4)')}, {facts.path('(p_partkey + 7)')}] END AS items FROM part WHERE p_partkey % 10 = 2)"


def blocks(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 10 = 2")
    items = f"CASE WHEN p_size % 5 = 0 THEN cast(array() AS array<string>) ELSE array({facts.path('(p_partkey + 4)')}, {facts.path('(p_partkey + 7)')}) END AS items"
    return p.selectExpr(f"{facts.path('p_partkey')} AS self_type", "p_size % 3 = 0 AS of_trait", "CASE WHEN p_size > 45 THEN NULL ELSE p_partkey * 10 END AS lo", "p_partkey * 10 + 5 AS hi", "'f' AS file", items)


@query(f"""WITH {MODEL}, {BLOCKS}, rp AS (SELECT DISTINCT d.path FROM g JOIN d ON g.cfg = d.cfg AND g.key = d.key),
ix AS (SELECT DISTINCT self_type FROM (SELECT self_type, unnest(items) AS i FROM bl WHERE NOT of_trait AND lo IS NOT NULL) WHERE i IN (SELECT path FROM rp)),
k AS (SELECT self_type, min(CASE WHEN of_trait THEN 1 WHEN lo IS NULL THEN 2 WHEN self_type IN (SELECT self_type FROM ix) THEN 3 END) AS rank FROM bl GROUP BY 1)
SELECT self_type, CASE rank WHEN 1 THEN 'trait-impl' WHEN 2 THEN 'no-editable-surface' ELSE 'item-reached' END AS reason FROM k WHERE rank IS NOT NULL""")
def impls_keeping(spark, d):
    x = facts.defs(spark, d)
    reached = folded(spark, d, x).join(x, ["cfg", "key"]).select("path").distinct()
    return guards.impls_keeping(blocks(spark, d), x.where("key % 10 = 2").select(F.col("path").alias("self_type")).distinct(), reached)


@query(f"""WITH {D}, {BLOCKS}, rm AS (SELECT DISTINCT path FROM d WHERE key % 30 IN (2, 16, 19, 26)),
lv AS (SELECT DISTINCT lo FROM (SELECT lo, unnest(items) AS i FROM bl) x WHERE NOT EXISTS (SELECT 1 FROM rm WHERE i = rm.path OR starts_with(i, rm.path || '::')))
SELECT file, lo, hi, self_type, self_type IN (SELECT path FROM rm) AS with_type FROM bl WHERE NOT of_trait AND lo IS NOT NULL AND (self_type IN (SELECT path FROM rm) OR (len(items) > 0 AND lo NOT IN (SELECT lo FROM lv WHERE lo IS NOT NULL)))""")
def impl_block_deletions(spark, d):
    rm = facts.defs(spark, d, "key", "path").where("key % 30 IN (2, 16, 19, 26)").select("path").distinct()
    return guards.impl_block_deletions(blocks(spark, d), rm)


@query(f"""WITH {D}, {E}, {LAND}, {REX}, ch AS (SELECT DISTINCT d.cfg, rxm.path AS module, d.path FROM rxm JOIN d ON rxm.cfg = d.cfg AND {UP.format('d.path')} = rxm.path AND d.public WHERE rxm."glob"), tr AS (SELECT DISTINCT path FROM d WHERE key % 10 IN (1, 2, 5)),
em AS (SELECT cfg, module FROM ch GROUP BY ALL HAVING bool_and(path IN (SELECT path FROM tr))) SELECT path, min_by(module, (cfg, module)) AS module FROM ch JOIN em USING (cfg, module) GROUP BY path""")
def glob_emptied(spark, d):
    x = facts.defs(spark, d)
    own = model.reexports(land(spark, d)).where("glob").join(x.where("kind = 'mod'").select("cfg", "key", F.col("path").alias("module")).withColumnRenamed("module", "m"), ["cfg", "key"]).select("cfg", F.col("m").alias("module")).distinct()
    kids = model.public_children(x).join(own, ["cfg", "module"], "left_semi")
    trial = x.where("key % 10 IN (1, 2, 5)").select("path").distinct()
    return guards.glob_emptied(kids, trial, trial)


@query(f"""WITH {D}, {E}, {LAND}, {IDENT} SELECT identity, CASE WHEN bool_or(elem % 7 = 0) THEN 'macro-generated' ELSE 'generated-file' END AS reason FROM i WHERE import AND identity IS NOT NULL AND (elem % 7 = 0 OR file LIKE '%m3%') GROUP BY 1""")
def excision_blocked(spark, d):
    e = identified(spark, d, "elem").withColumn("decl_lo", F.col("lo")).withColumn("decl_expansion", F.col("elem") % 7 == 0)
    return imports.excision_blocked(e, e.where("file like '%m3%'").select(F.col("file").alias("path")).distinct())


@query(f"""WITH RECURSIVE {E}, gl AS (SELECT DISTINCT split_part(from_path, '::', 1) AS crate, 'm' || (to_key % 9) AS module, 'm' || (from_key % 11) AS importer FROM e WHERE import AND "glob"),
ch AS (SELECT crate, module AS scope, importer FROM gl UNION SELECT ch.crate, ch.scope, gl.importer FROM ch JOIN gl ON ch.crate = gl.crate AND ch.importer = gl.module) SELECT crate, scope, importer FROM ch""")
def glob_chains(spark, d):
    e = facts.edges(spark, d).where("import and glob")
    return imports.glob_chains(e.selectExpr("split(from_path, '::')[0] AS crate", "concat('m', to_key % 9) AS module", "concat('m', from_key % 11) AS importer").distinct())


@query(f"""WITH {D}, rm AS (SELECT DISTINCT path FROM d WHERE key % 10 = 6), gp AS (SELECT DISTINCT {facts.block('key')} AS gid, path FROM d) SELECT gid, path FROM gp WHERE gid NOT IN (SELECT gid FROM gp WHERE path IN (SELECT path FROM d WHERE key % 50 = 25))""")
def atomic_groups(spark, d):
    x = facts.defs(spark, d, "key", "path")
    groups = x.selectExpr(f"{facts.block('key')} AS gid", "path").distinct()
    return guards.drop_groups(groups, x.where("key % 50 = 25").select("path"))


LINKS = f"lk AS (SELECT DISTINCT 'n' || ((l_orderkey * 13 + l_linenumber * 17) % 400) AS src, 'n' || (l_partkey % 400) AS dst FROM lineitem WHERE l_linenumber = 5 AND l_quantity < 12), it AS (SELECT 'n' || i AS path FROM range(400) t(i) WHERE i % 3 > 0), tg AS (SELECT 'n' || i AS path FROM range(400) t(i) WHERE i % 40 = 0)"


def links(spark, d):
    e = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 5 AND l_quantity < 12").selectExpr("concat('n', (l_orderkey * 13 + l_linenumber * 17) % 400) AS src", "concat('n', l_partkey % 400) AS dst").distinct()
    n = spark.range(400)
    return e, n.where("id % 3 > 0").selectExpr("concat('n', id) AS path"), n.where("id % 40 = 0").selectExpr("concat('n', id) AS path")


@query(f"""WITH RECURSIVE {LINKS}, cl AS (SELECT src AS path FROM lk WHERE dst IN (SELECT path FROM tg) AND src IN (SELECT path FROM it) UNION SELECT lk.dst FROM cl JOIN lk ON cl.path = lk.src WHERE lk.dst IN (SELECT path FROM it) AND lk.dst NOT IN (SELECT path FROM tg)) SELECT path FROM cl""")
def scaffold_universe(spark, d):
    e, items, targets = links(spark, d)
    return scaffold.referrer_closure(e, items, targets, targets.limit(0))
