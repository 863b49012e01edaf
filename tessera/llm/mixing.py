"""Mixing sources to target weights (operator 4): pivotal dependent rounding over a reduction tree.

A source's target is its share, by weight, of a budget; targets stop at `most` times the source's size
and the excess goes to the others. A document is then worth c = target / source size copies: the whole
part is certain and the fraction is rounded. Pivotal rounding pairs the longest open document of a block with
the shorter ones taken together and moves mass between the two sides, up or down at random so that expectations hold,
until the long one is integral; mass is moved in words, dealt evenly to the shorter ones, so the sum of words is
kept exactly. What stays open at the end of a block is its shortest document alone. These residuals meet in a
tree of `fanout`, level by level, until one a source is left, which is rounded alone: a source misses its
target by about the size of its shortest documents, and by more only where a few long ones hold most of its
words. Randomness is a hash of seed, doc_id and text: reruns agree.

Rules: size is the number of words [^\\x20\\x09-\\x0D]+ (null text: 0). Documents without words take 0.
Null sources are one source, ranked last. Sources without words have target 0. Rows that share a doc_id are rounded
row by row; those equal in doc_id, source and text share a block and can trade places. Documents of
equal size are ordered by their hash. A very long text is one document as any other. An empty table gives an
empty result. Extra columns are ignored by `mix` and kept by `mix_documents`, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exchange import ensure_checkpoint_dir, free_name
from .textvec import mix64

BLOCK_DOCS = 1000
FANOUT = 1000
ROW = "rank int, block long, doc_id long, h long, size long, whole int, p double, extra int"


def row_key(doc_id: str, text: str, source: str):
    """The same for rows equal in all three."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(source).cast("string"), F.col(text))


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    # runs of characters that are not white space, each become one mark
    runs = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    size = F.length(F.regexp_replace(runs, "[\\x20\\x09-\\x0D]+", "")).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), row_key(doc_id, text, source).alias("h"), size.alias("size"))


def targets(rows: DataFrame, weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """(source, rank, n, source_size, target): one row a source; the driver sees three numbers a round."""
    by = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = by.withColumn("rank", rank.cast("int")).withColumn("w", w).checkpoint()
    level, known = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("w") * level > most * F.col("source_size")
        total, full, open_w, n = src.agg(
            F.sum("source_size"), F.sum(F.when(capped, most * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w"))), F.count_if(capped)
        ).first()
        if n == known or not total or not open_w:
            break
        known, level = n, float(Fraction(total) * share - full) / open_w
    target = F.least(F.col("w") * F.lit(level or 0.0), (most * F.col("source_size")).cast("double"))
    return src.select("source", "rank", "n", "source_size", target.alias("target"))


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, float]:
    """Rounded p (0 or 1 each) of all but the last, and the last one's fraction. From long to short.

    A document that is rounded up takes the words it lacks evenly from all that follow, and one rounded down
    gives its words to them: their fractions move by `shift`, beyond 0 and 1 where a long one holds most words.
    """
    out, shift = np.zeros(len(p), np.int32), 0.0
    rest = float(size.sum())
    for i, (n, q, x) in enumerate(zip(size.tolist(), p.tolist(), u.tolist(), strict=True)):
        q += shift
        rest -= n
        if i == len(p) - 1:
            return out, q
        taken = x < q
        out[i] = taken
        shift += (q - taken) * n / rest
    return out, 0.0


def unit(keys: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each key."""
    h = mix64(mix64(keys.view(np.uint64) + np.uint64(seed)))
    return (h >> np.uint64(11)).astype(float) / (1 << 53)


def round_block(seed: int, last: bool):
    def work(table: pa.Table) -> pa.Table:
        key = np.ascontiguousarray(table["h"].to_numpy())
        by = np.lexsort((key, unit(key, seed), -table["size"].to_numpy()))
        t, key = table.take(pa.array(by)), key[by]
        extra, p = pivot(t["size"].to_numpy(), t["p"].to_numpy(), unit(key, seed + 1))
        open_ = np.arange(len(key)) == len(key) - 1
        if last:
            extra[-1] = unit(key[-1:], seed + 2)[0] < p
        new = np.where(open_, p, t["p"].to_numpy())
        cols = {c: t[c] for c in ("rank", "block", "doc_id", "h", "size", "whole")}
        return pa.table({**cols, "p": pa.array(new), "extra": pa.array(extra, mask=open_ & (not last))})

    return work


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, h, size, source_size, target, copies of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = sized(docs, doc_id, text, source).checkpoint()
    src = targets(rows, weights, share, most).checkpoint()
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = rows.join(src, rows.source.eqNullSafe(src.source)).withColumn("c", copies)
    whole = F.floor(F.col("c") + 1e-12).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_DOCS))
    state = dealt.where("size > 0").select(
        "rank", F.pmod("h", blocks).alias("block"), "doc_id", "h", "size", whole.alias("whole"), F.greatest(F.col("c") - whole, F.lit(0.0)).alias("p"), F.lit(None).cast("int").alias("extra")
    )
    n_blocks = src.agg(F.max(F.ceil(F.col("n") / BLOCK_DOCS))).first()[0] or 1
    settled = []
    level = 0
    while True:
        last = level > 0 and n_blocks <= 1
        state = state.groupBy("rank", "block").applyInArrow(round_block(seed + 3 * level, last), ROW).checkpoint()
        settled.append(state.where("extra is not null"))
        if last:
            break
        state = state.where("extra is null").withColumn("block", F.floor(F.col("block") / FANOUT))
        n_blocks = -(-n_blocks // FANOUT)
        level += 1
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    kept = out.select("doc_id", "h", "rank", "size", (F.col("whole") + F.col("extra")).alias("copies"))
    none = dealt.where("size = 0").select("doc_id", "h", "rank", "size", F.lit(0).alias("copies"))
    return kept.unionByName(none).join(src.select("rank", "source_size", "target"), "rank").select("doc_id", "h", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; `how` as for `mixed`."""
    return mixed(docs, **how).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it."""
    h, n, k, i = (free_name(docs, x) for x in ("_h", "_n", "_k", "_i"))
    rows = mixed(docs, doc_id=doc_id, text=text, source=source, **how)
    # rows equal in all three are told apart by their place among each other
    copies = rows.groupBy(F.col("h").alias(h)).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(n)).where(F.get(n, F.lit(0)) > 0)
    keyed = docs.withColumn(h, row_key(doc_id, text, source))
    placed = keyed.withColumn(k, F.row_number().over(Window.partitionBy(h).orderBy(h)) - 1).join(copies, h).withColumn(n, F.get(n, F.col(k)))
    return placed.where(F.col(n) > 0).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
