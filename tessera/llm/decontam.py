"""Benchmark decontamination (operator 7, native): winnowed fingerprints joined, then hits extended.

Winnowing keeps the smallest hash of k-word grams in every run of window - k + 1 grams, so documents and
items that share `window` consecutive words share a kept fingerprint at the same place. Fingerprints of
documents are joined with those of the items; around each match all windows are compared with the items'
windows by a 128-bit hash. A value packs 40 bits of a gram's hash with 24 bits of its position, so one
minimum yields both. Items shorter than a window are one window of their own length; for each such length
that occurs, all grams of that length are compared.

The items' tables are broadcast only when their counted bytes stay under BROADCAST_BYTES. Larger ones are
joined by shuffle: fingerprints go out as (document, place), and what matches comes back to the texts, which are
shuffled once. The two halves of the 128-bit hash start from different states, so neither follows from the other.

Rules: A-Z is lower-cased and words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Null and empty texts have no words;
items without words match nothing, repeated item rows count once, null item_ids never match. Rows that
share a doc_id are told apart by their texts, and those with equal texts are judged alike; null doc_ids are ids like
others. A very long text costs as many fingerprints as it has; places beyond 2**24 words are taken modulo that and all
are compared. An empty table of documents gives no rows, one of items no hits. Extra columns are ignored, and kept
by `drop_contaminated` whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ensure_checkpoint_dir, free_name

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BROADCAST_BYTES = 64 << 20
MASK = (1 << 24) - 1


def with_words(df: DataFrame, text: str) -> DataFrame:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return df.withColumn("words", F.filter(F.split(low, NOT_WORD), lambda w: w != ""))


def _gram(at: str, k: int, salt: str = "") -> str:
    """A hash of k words; a salt comes first, since each argument is hashed onto the state that those before it left."""
    return f"xxhash64({salt}{', '.join(f'get(words, {at} + {j})' for j in range(k))})"


def fingerprints(df: DataFrame, window: int, k: int) -> DataFrame:
    """df with fp: distinct packed (hash, position) of the kept grams."""
    w = window - k + 1
    rows = df.withColumn("v", F.expr(f"transform(words, (x, i) -> shiftleft({_gram('i', k)}, 24) | (cast(i as bigint) & {MASK}L))"))
    least = ", ".join(f"get(v, i + {j})" for j in range(w))
    kept = f"array_distinct(transform(slice(v, 1, greatest(size(words) - {window - 1}, 0)), (x, i) -> least({least})))"
    return rows.withColumn("fp", F.expr(kept)).drop("v")


def _sized(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """df, marked for broadcast if its counted bytes are few, and whether it is."""
    df = df.checkpoint()
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t == "string" else F.lit(16)) for c, t in df.dtypes)
    small = (df.agg(F.sum(width)).first()[0] or 0) <= most
    return (F.broadcast(df) if small else df), small


def item_windows(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(item_id, len, h1, h2) of every window of every item."""
    rows = with_words(items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), "text")
    long = rows.where(F.size("words") >= window).withColumn("i", F.explode(F.expr(f"sequence(0, size(words) - {window})")))
    long = long.select("item_id", F.lit(window).alias("len"), F.expr(_gram("i", window)).alias("h1"), F.expr(_gram("i", window, "1, ")).alias("h2"))
    found = long
    for n in range(1, window):
        part = rows.where(F.size("words") == n)
        found = found.unionByName(part.select("item_id", F.lit(n).alias("len"), F.expr(_gram("0", n)).alias("h1"), F.expr(_gram("0", n, "1, ")).alias("h2")))
    return found.distinct()


def matches(docs: DataFrame, items: DataFrame, window: int, k: int, item_id: str, text: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, h, start, len, item_id) of every occurrence of an item's window; h hashes the text."""
    ensure_checkpoint_dir(docs.sparkSession)
    bench = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    windows, _ = _sized(item_windows(bench, window, "item_id", "text"), most)
    marks = fingerprints(with_words(bench, "text"), window, k).select(F.explode_outer("fp").alias("f")).select(F.shiftrightunsigned("f", 24).alias("mark")).where("mark is not null").distinct()
    marks, small = _sized(marks, most)
    rows = with_words(docs, "text").select("doc_id", F.xxhash64("text").alias("h"), "words")
    # explode_outer: explode would have its array tested for emptiness below, computing it a second time
    seen = fingerprints(rows, window, k).withColumn("f", F.explode_outer("fp")).withColumn("mark", F.shiftrightunsigned("f", 24))
    if small:
        seen = seen.join(marks, "mark").select("doc_id", "h", "words", "f")
    else:
        narrow = seen.select("doc_id", "h", "f", "mark").join(marks, "mark").groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_set("f").alias("fs"))
        once = rows.dropDuplicates(["doc_id", "h"])
        seen = once.join(narrow, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).select("doc_id", "h", "words", F.explode("fs").alias("f"))
    # places congruent to the packed position: one, but in texts of more than 2**24 words
    place = F.explode_outer(F.expr(f"sequence(cast(f & {MASK}L as int), size(words) - {k}, {MASK + 1})"))
    seen = seen.select("doc_id", "h", "words", place.alias("p"))
    reach = F.explode_outer(F.expr(f"sequence(greatest(p - {window - k}, 0), least(p, size(words) - {window}))"))
    seen = seen.select("doc_id", "h", "words", reach.alias("start"))
    seen = seen.select("doc_id", "h", "start", F.lit(window).alias("len"), F.expr(_gram("start", window)).alias("h1"), F.expr(_gram("start", window, "1, ")).alias("h2"))
    found = seen.join(windows, ["len", "h1", "h2"]).select("doc_id", "h", "start", "len", "item_id")
    short = [r[0] for r in windows.where(F.col("len") < window).select("len").distinct().collect()]  # at most window - 1 lengths
    for n in short:
        part = rows.where(F.size("words") >= n).withColumn("start", F.explode(F.expr(f"sequence(0, size(words) - {n})")))
        part = part.select("doc_id", "h", "start", F.lit(n).alias("len"), F.expr(_gram("start", n)).alias("h1"), F.expr(_gram("start", n, "1, ")).alias("h2"))
        found = found.unionByName(part.join(windows.where(F.col("len") == n), ["len", "h1", "h2"]).select("doc_id", "h", "start", "len", "item_id"))
    return found


def hits(docs: DataFrame, items: DataFrame, window: int = 8, k: int = 4, item_id: str = "item_id", item_text: str = "text", most: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, h, n_hit, item_ids, longest) of documents with any match; item_ids sorted as strings, longest the widest window hit."""
    found = matches(docs, items, window, k, item_id, item_text, most)
    by_doc = found.groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
        F.max("len").alias("longest"),
    )
    # spans in order of start: each adds what lies beyond the furthest end so far
    fold = """aggregate(spans, struct(0L as n, 0 as reach),
        (s, x) -> struct(s.n + greatest(x.end - greatest(x.start, s.reach), 0) as n, greatest(x.end, s.reach) as reach), s -> s.n)"""
    return by_doc.select("doc_id", "h", F.expr(fold).alias("n_hit"), "item_ids", "longest")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, k: int = 4, least_items: int = 2, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = hits(own, items, window, k, item_id, item_text, most)
    counts = with_words(own, "text").select("doc_id", F.xxhash64("text").alias("h"), F.size("words").cast("long").alias("n_words"))
    joined = counts.join(found.withColumnRenamed("doc_id", "_id").withColumnRenamed("h", "_h"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(ids) >= least_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 8, k: int = 4, least_items: int = 1, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", short_alone: bool = True) -> DataFrame:
    """docs without those that hold windows of `least_items` items or more.

    Without `short_alone`, a single item of less than `window` words removes no document.
    """
    found = hits(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, window, k, item_id, item_text)
    if not short_alone:
        found = found.where((F.col("longest") == window) | (F.size("item_ids") > 1))
    i, h = free_name(docs, "_id"), free_name(docs, "_h")
    bad = found.where(F.size("item_ids") >= least_items).select(F.col("doc_id").alias(i), F.col("h").alias(h))
    return docs.join(bad, docs[doc_id].eqNullSafe(bad[i]) & (F.xxhash64(docs[text]) == bad[h]), "left_anti")
