"""Sharding (operator 6, native): k-d tree partitioning at distributed weighted medians.

A node that is to become s shards is cut into s // 2 and s - s // 2 at the weighted quantile of its
bytes, along the metadata dimension with the widest range; leaves hold the target bytes. Dimensions are
the source, the language, the size and the text's checksum, each as 24 bits, followed by tie bits of the text.

The points of the tree are groups of equal texts, not rows: a group takes its smallest source and language, so
its key is one and no cut runs through it. Only groups of more bytes than a shard are cut, into pieces that
stand beside each other; at most `n_shards` groups can be that large, so their table is broadcast. Points
of more than 1 / HEAVY of a shard can't be cut at the quantile: of these a node takes the median first, and the
cut of the light points then makes up for what the heavy ones left uneven.

A quantile is found by histograms of BINS bins a node: each round, one aggregation over all documents
serves all nodes of a level and returns at most BINS rows a node; the bin that holds the quantile is refined.
Beyond TOP nodes a level is cut by window functions inside the nodes instead, so neither the driver nor the
expression grows with the number of shards. The law is `bytes`: sizes of shards are near equal.

Rules: size is the UTF-8 bytes of the text (null: none) plus `overhead`; null and empty texts are equal texts, null
sources and languages count as the empty string, null ids as any other; rows that share a doc_id are rows of their
own, and equal texts stay together whatever their ids. Ties of keys are groups that go the same way. A text longer
than a shard makes a shard larger than the others. An empty table gives an empty result. Slots are
gapless from 0 in each shard. Extra columns are ignored by `shard` and kept by `shard_documents`, which replaces
a column named `shard`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exchange import ensure_checkpoint_dir, free_name

DIMS = ("k_source", "k_lang", "k_size", "k_text")
BINS = 2048
ROUNDS = 5
HEAVY = 64
TOP = 128
VALUE_BITS, TEXT_BITS, PIECE_BITS = 24, 19, 20


@dataclass
class Node:
    shards: int
    first: int
    dim: int = 0
    cut: int = 0
    heavy_cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def leaves(self):
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def expr(self, at) -> Column:
        """The tree as one nested CASE; at(leaf) gives a leaf's value."""
        if self.left is None:
            return at(self)
        low = F.col(DIMS[self.dim]) < F.when(F.col("heavy"), F.lit(self.heavy_cut).cast("long")).otherwise(F.lit(self.cut).cast("long"))
        return F.when(low, self.left.expr(at)).otherwise(self.right.expr(at))


def size_of(overhead: int, text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def tag_of(text: str = "text") -> tuple[Column, Column]:
    """Two checksums of the text: equal texts share both."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return F.xxhash64(body), F.crc32(body)


def piece_of(doc_id: Column, pieces: Column) -> Column:
    return F.when(pieces.isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(doc_id), pieces))


def points(docs: DataFrame, n_shards: int | None, target_bytes: int, overhead: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows with the keys of their group, groups larger than a shard with their pieces, number of shards)."""
    tag, crc = tag_of()
    code = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", size_of(overhead).alias("size"), crc.alias("text_crc32"), tag.alias("tag"), code("source").alias("s"), code("lang").alias("l")).checkpoint()
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_shards = n_shards or max(1, -(-total // target_bytes))
    fair = max(1, total // n_shards)
    sums = rows.groupBy("tag", "text_crc32").agg(F.sum("size").alias("b"), F.min("s").alias("gs"), F.min("l").alias("gl")).where(F.col("b") > fair)
    # their bytes add up to the total at most, so there are no more than n_shards of them
    large = sums.select("tag", "text_crc32", "gs", "gl", F.least(F.ceil(F.col("b") * HEAVY / fair), F.lit((1 << PIECE_BITS) - 1)).cast("long").alias("pieces")).checkpoint()
    rows = rows.join(F.broadcast(large), ["tag", "text_crc32"], "left").withColumn("piece", piece_of(F.col("doc_id"), F.col("pieces"))).drop("pieces")
    group = Window.partitionBy("tag", "text_crc32", "piece")
    rows = rows.withColumns({"s": F.coalesce("gs", F.min("s").over(group)), "l": F.coalesce("gl", F.min("l").over(group)), "heavy": F.sum("size").over(group) > fair // HEAVY})
    tie = F.shiftleft(F.shiftrightunsigned("tag", 64 - TEXT_BITS), PIECE_BITS) + F.col("piece")
    values = (F.shiftright("s", 8), F.shiftright("l", 8), F.floor(F.log2("size") * (1 << 18)), F.shiftright("text_crc32", 8))
    keys = {d: F.shiftleft(v.cast("long"), TEXT_BITS + PIECE_BITS) + tie for d, v in zip(DIMS, values, strict=True)}
    return rows.withColumns(keys).drop("s", "l", "gs", "gl").checkpoint(), large.drop("gs", "gl"), n_shards


def grow(rows: DataFrame, n_shards: int) -> Node:
    """The tree, level by level, up to TOP open nodes; the driver sees at most BINS rows a node."""
    root, spread = Node(n_shards, 0), None
    while True:
        open_ = [x for x in root.leaves() if x.shards > 1]
        if not open_ or len(open_) > TOP:
            return root
        index = {id(x): i for i, x in enumerate(open_)}
        node = root.expr(lambda x: F.lit(index.get(id(x), -1)))
        ends = [f(d) for d in DIMS for f in (F.min, F.max)]
        stats: dict[int, dict] = {}
        for r in rows.groupBy(node.alias("node"), "heavy").agg(F.sum("size"), *ends).where("node >= 0").collect():
            stats.setdefault(r[0], {})[r[1]] = (r[2], r[3::2], r[4::2])
        seek: dict[bool, dict] = {True: {}, False: {}}
        for i, parts in stats.items():
            x, half = open_[i], open_[i].shards // 2
            low, high = ([f(p[j][d] for p in parts.values()) for d in range(len(DIMS))] for j, f in ((1, min), (2, max)))
            spread = spread or [max(1, b - a) for a, b in zip(low, high, strict=True)]
            x.dim = max(range(len(DIMS)), key=lambda d: (round((high[d] - low[d]) / spread[d], 3), -d))
            total = sum(p[0] for p in parts.values())
            for heavy, p in parts.items():
                seek[heavy][i] = {"lo": p[1][x.dim], "hi": p[2][x.dim], "below": 0, "want": p[0] * half / x.shards, "all": total * half / x.shards, "fine": total / x.shards * 1e-4}
        got = quantiles(rows.where("heavy"), root, open_, index, seek[True])
        for i, (cut, taken) in got.items():
            open_[i].heavy_cut = cut
            if i in seek[False]:
                seek[False][i]["want"] = seek[False][i]["all"] - taken
        for i, (cut, _) in quantiles(rows.where("not heavy"), root, open_, index, seek[False]).items():
            open_[i].cut = cut
        for x in open_:
            half = x.shards // 2
            x.left, x.right = Node(half, x.first), Node(x.shards - half, x.first + half)


def quantiles(rows: DataFrame, root: Node, open_: list[Node], index: dict, todo: dict) -> dict[int, tuple[int, int]]:
    """For each open node sought: the key at which its cut lies, and the bytes below it."""
    done: dict[int, tuple[int, int]] = {}
    for n in range(ROUNDS):
        if not todo:
            break
        for t in todo.values():
            t["step"] = (t["hi"] - t["lo"]) // BINS + 1

        def bin_of(x: Node) -> Column:
            i = index.get(id(x))
            if i not in todo:
                return F.lit(-1).cast("long")
            t, k = todo[i], DIMS[x.dim]
            cell = F.lit(i * BINS).cast("long") + F.expr(f"({k} - {t['lo']}L) div {t['step']}L")
            return F.when((F.col(k) >= t["lo"]) & (F.col(k) <= t["hi"]), cell).otherwise(F.lit(-1).cast("long"))

        found = rows.groupBy(root.expr(bin_of).alias("cell")).agg(F.sum("size"), *[F.min(d) for d in DIMS], *[F.max(d) for d in DIMS]).where("cell >= 0").collect()
        by_node: dict[int, list] = {}
        for r in found:
            by_node.setdefault(r[0] // BINS, []).append(r)
        for i in list(todo):
            t, x = todo[i], open_[i]
            total, cut = t["below"], t["lo"]
            for r in sorted(by_node.get(i, [])):
                lo, hi = r[2 + x.dim], r[2 + len(DIMS) + x.dim]
                if total + r[1] < t["want"]:
                    total, cut = total + r[1], hi + 1
                    continue
                if n < ROUNDS - 1 and lo < hi and r[1] > t["fine"]:
                    t.update(lo=lo, hi=hi, below=total)
                    break
                done[i] = (hi + 1, total + r[1]) if total + r[1] - t["want"] < t["want"] - total else (cut if total > t["below"] else lo, total)
                del todo[i]
                break
            else:
                done[i] = (cut, total)
                del todo[i]
    return done


def deepen(placed: DataFrame, most: int) -> DataFrame:
    """Cut nodes of several shards to single ones, all of a level at once, by running sums inside each node."""
    while most > 1:
        node = Window.partitionBy("shard")
        width = F.array(*[(F.max(d).over(node) - F.min(d).over(node)) for d in DIMS])
        wide = placed.withColumn("w", width).withColumn("at", F.array_position("w", F.array_max("w")).cast("int"))
        wide = wide.withColumn("k", F.element_at(F.array(*DIMS), F.col("at")))
        # equal keys are peers: they are counted as one and go the same way
        upto, same = Window.partitionBy("shard").orderBy("k").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("shard", "k")
        half = F.floor(F.col("shards") / 2).cast("int")
        left = F.sum("size").over(upto) - F.sum("size").over(same) / 2 <= F.sum("size").over(node) * half / F.col("shards")
        cut = wide.withColumn("left", left | (F.col("shards") == 1))
        placed = cut.select(
            *[c for c in placed.columns if c not in ("shard", "shards")],
            F.when(F.col("left"), F.col("shard")).otherwise(F.col("shard") + half).alias("shard"),
            F.when(F.col("shards") == 1, 1).when(F.col("left"), half).otherwise(F.col("shards") - half).alias("shards"),
        ).checkpoint()
        most = -(-most // 2)
    return placed


def assign(docs: DataFrame, n_shards: int | None, target_bytes: int, overhead: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, size, text_crc32, tag, piece, shard) of every row of docs (doc_id, text, lang, source); large groups; shards."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows, large, n_shards = points(docs, n_shards, target_bytes, overhead)
    tree = grow(rows, n_shards)
    placed = rows.withColumns({"shard": tree.expr(lambda x: F.lit(x.first)), "shards": tree.expr(lambda x: F.lit(x.shards))})
    placed = deepen(placed, max(x.shards for x in tree.leaves()))
    return placed.select("doc_id", "size", "text_crc32", "tag", "piece", "shard"), large, n_shards


def shard(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed, _, n_shards = assign(docs, n_shards, 1, overhead)
    # slots: rank within a part of a shard, plus the counts of the parts before it
    n_parts = max(16, placed.count() // (n_shards * 100_000))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_parts)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    ranked = placed.withColumn("rank", rank - 1).join(counts, ["shard", "part"])
    slot = (F.col("base") + F.col("rank")).alias("slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, n_shards: int | None = None, target_bytes: int = 256 << 20, overhead: int = 16) -> DataFrame:
    """docs with `shard` by the tree; n_shards defaults to the leaves that reach target_bytes."""
    docs = docs.drop("shard")
    placed, large, _ = assign(docs, n_shards, target_bytes, overhead)
    tag, crc, piece, pieces = (free_name(docs, x) for x in ("_tag", "_crc", "_piece", "_pieces"))
    at = placed.select(F.col("tag").alias(tag), F.col("text_crc32").alias(crc), F.col("piece").alias(piece), "shard").distinct()
    wide = docs.withColumns(dict(zip((tag, crc), tag_of(), strict=True)))
    wide = wide.join(F.broadcast(large.select(F.col("tag").alias(tag), F.col("text_crc32").alias(crc), F.col("pieces").alias(pieces))), [tag, crc], "left")
    wide = wide.withColumn(piece, piece_of(F.col("doc_id"), F.col(pieces)))
    return wide.join(at, [tag, crc, piece]).select(*docs.columns, "shard")
