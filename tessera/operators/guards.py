"""Guards of deletion and narrowing: members, fields, variants, impl blocks, globs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import ADT_KINDS, name_of, no, parent, trait_parent

DELETABLE = ("fn", "const", "static", "type")  # fixed values


def assoc_members(defs: DataFrame) -> DataFrame:
    """(cfg, owner, key): functions by their self type, or by the trait that declares them."""
    f = defs.where("kind = 'fn'").select("cfg", "key", "self_type").join(trait_parent(defs), ["cfg", "key"], "left")
    return f.select("cfg", F.coalesce("self_type", "trait_key").alias("owner"), "key").where("owner is not null")


def landings(defs: DataFrame, kind: str, keep_underscore: bool = False) -> DataFrame:
    """(cfg, owner, key, name): fields or variants by the type that holds them; a variant's field belongs to the enum."""
    at = defs.groupBy("cfg", F.col("path").alias("_p")).agg(F.min_by(F.struct("key", "kind"), "key").alias("_d"))
    some = defs.where(F.col("kind") == kind).select("cfg", "key", name_of("path").alias("name"), parent("path").alias("_p1"))
    some = some.where(F.lit(keep_underscore) | ~F.col("name").startswith("_")).withColumn("_p2", parent("_p1"))
    j = some.join(at.select("cfg", F.col("_p").alias("_p1"), F.col("_d").alias("_d1")), ["cfg", "_p1"], "left").join(at.select("cfg", F.col("_p").alias("_p2"), F.col("_d").alias("_d2")), ["cfg", "_p2"], "left")
    one, two = F.col("_d1.key"), F.col("_d2.key")
    owner = F.when(F.col("_d1").isNull() | (F.col("_d1.kind") == "variant"), two).otherwise(one) if kind == "field" else one
    return j.select("cfg", owner.alias("owner"), "key", "name").where("owner is not null")


def any_unreached(members: DataFrame, deg: DataFrame) -> DataFrame:
    """(cfg, owner, unreached): some member has no use. members(cfg, owner, key); deg(cfg, key)."""
    used = deg.select("cfg", "key", F.lit(True).alias("_u"))
    return members.join(used, ["cfg", "key"], "left").groupBy("cfg", "owner").agg(F.bool_or(F.col("_u").isNull()).alias("unreached"))


def trait_members(defs: DataFrame) -> DataFrame:
    return trait_parent(defs).select("cfg", F.col("trait_key").alias("owner"), "key")


def inherent_members(defs: DataFrame) -> DataFrame:
    """Members of structs, enums and unions."""
    types = defs.where(F.col("kind").isin(*ADT_KINDS)).select("cfg", F.col("key").alias("owner"))
    return assoc_members(defs).join(types, ["cfg", "owner"], "left_semi")


def variant_names(defs: DataFrame) -> DataFrame:
    """(cfg, owner, names) of every enum, underscore names included."""
    return landings(defs, "variant", True).groupBy("cfg", "owner").agg(F.array_sort(F.collect_list("name")).alias("names"))


def unmasked(gone: DataFrame, defs: DataFrame, deg_after: DataFrame, removed: DataFrame, homes: DataFrame) -> DataFrame:
    """(source, owner, name, kind): fields without a read and variants without a construction once `gone` edges are.

    gone: landed edges that go; deg_after(cfg, key): degrees that stay; removed(path); homes(krate, home). Exported landings of
    exported types, types that go too and configs that are not the type's home are no hits.
    """
    land = landings(defs, "field").withColumn("kind", F.lit("field")).unionByName(landings(defs, "variant").withColumn("kind", F.lit("variant")))
    pub = defs.select("cfg", "key", F.col("public").alias("_lp"))
    own = defs.select("cfg", F.col("key").alias("owner"), F.col("public").alias("_op"), F.col("path").alias("owner_path"), "krate")
    j = gone.where("key is not null and not import").select("cfg", "key", F.col("from_path").alias("source")).join(land, ["cfg", "key"])
    j = j.join(deg_after.select("cfg", "key"), ["cfg", "key"], "left_anti").join(pub, ["cfg", "key"]).join(own, ["cfg", "owner"]).where("not (_lp and _op)")
    j = j.join(homes, "krate").where("cfg = home").join(removed.select(F.col("path").alias("owner_path")), "owner_path", "left_anti")
    return j.select("source", F.col("owner_path").alias("owner"), "name", "kind").distinct()


def len_without_is_empty(defs: DataFrame, removed: DataFrame) -> DataFrame:
    """(path, owner): removed public `is_empty` functions whose owner stays with a public `len(&self)`; judged in the first config."""
    mine = assoc_members(defs)
    d = defs.join(mine, ["cfg", "key"], "left")
    own = defs.select("cfg", F.col("key").alias("owner"), F.col("path").alias("owner_path"))
    gone = removed.select("path").distinct()
    empties = d.join(gone, "path").where(name_of("path") == "is_empty").groupBy("path").agg(F.min_by(F.struct("cfg", "owner", "kind", "public"), "cfg").alias("s")).select("path", "s.*")
    empties = empties.where("kind = 'fn' and public").join(own, ["cfg", "owner"]).join(gone.withColumnRenamed("path", "owner_path"), "owner_path", "left_anti")
    lens = d.where("public and self_kind = 'ref'").where(name_of("path") == "len").join(gone, "path", "left_anti").select("cfg", "owner").distinct()
    return empties.join(lens, ["cfg", "owner"], "left_semi").select("path", F.col("owner_path").alias("owner"))


def impls_keeping(blocks: DataFrame, types: DataFrame, reached: DataFrame) -> DataFrame:
    """(self_type, reason): why written impl blocks keep a dead type. blocks(self_type, of_trait, lo, items); types(self_type); reached(path)."""
    b = blocks.join(types.select("self_type").distinct(), "self_type")
    items = b.where("not of_trait and lo is not null").select("self_type", F.explode("items").alias("path")).join(reached.select("path").distinct(), "path")
    hit = items.select("self_type", F.lit(3).alias("rank"))
    first = b.where(F.col("of_trait") | F.col("lo").isNull()).select("self_type", F.when(F.col("of_trait"), 1).otherwise(2).alias("rank"))
    best = first.unionByName(hit).groupBy("self_type").agg(F.min("rank").alias("rank"))
    return best.select("self_type", F.when(F.col("rank") == 1, "trait-impl").when(F.col("rank") == 2, "no-editable-surface").otherwise("item-reached").alias("reason"))


def impl_block_deletions(blocks: DataFrame, removed: DataFrame) -> DataFrame:
    """(file, lo, hi, self_type, with_type): written inherent blocks that go with their type or with all of their items."""
    gone = removed.select("path").distinct()
    b = blocks.where("not of_trait and lo is not null")
    parts = F.split("i", "::")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))
    each = b.select("file", "lo", "hi", "self_type", F.explode_outer("items").alias("i"))
    near = each.where("i is not null").select("i", F.explode(up).alias("path")).distinct().join(gone, "path").select("i", F.lit(True).alias("_g")).distinct()
    by = each.join(near, "i", "left").groupBy("file", "lo", "hi", "self_type").agg(F.bool_and(no("_g")).alias("_all"), F.count("i").alias("_n"))
    j = by.join(gone.select(F.col("path").alias("self_type"), F.lit(True).alias("_t")), "self_type", "left")
    return j.where(no("_t") | (F.col("_all") & (F.col("_n") > 0))).select("file", "lo", "hi", "self_type", no("_t").alias("with_type"))


def glob_emptied(children: DataFrame, trial: DataFrame, newly: DataFrame) -> DataFrame:
    """(path, module): newly removed items whose module a glob re-export exports and that the trial empties. children(cfg, module, path)."""
    t = trial.select("path", F.lit(True).alias("_t")).distinct()
    all_gone = children.join(t, "path", "left").groupBy("cfg", "module").agg(F.bool_and(no("_t")).alias("e")).where("e")
    hit = children.join(all_gone, ["cfg", "module"], "left_semi").join(newly.select("path").distinct(), "path")
    return hit.groupBy("path").agg(F.min_by("module", F.struct("cfg", "module")).alias("module"))


def drop_groups(groups: DataFrame, vetoed: DataFrame) -> DataFrame:
    """(gid, path) of groups none of whose members is vetoed: a group goes as a whole or not at all."""
    bad = groups.join(vetoed.select("path").distinct(), "path", "left_semi").select("gid").distinct()
    return groups.join(bad, "gid", "left_anti")


def first_veto(vetoes: DataFrame) -> DataFrame:
    """(path, reason): the veto found first for each item. vetoes(path, rank, reason)."""
    return vetoes.groupBy("path").agg(F.min_by("reason", F.struct("rank", "reason")).alias("reason"))


def deletable() -> Column:
    """A test item that deletion can take: columns kind, synthetic, export_root, category, lo, from_expansion."""
    c = F.col
    return c("kind").isin(*DELETABLE) & ~c("synthetic") & ~c("export_root") & c("category").isin("module", "inherent") & c("lo").isNotNull() & ~F.coalesce(c("from_expansion"), F.lit(False))
