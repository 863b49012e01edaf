"""Owner exchange: which block of documents first holds a key, without a row for each key.

Documents are dealt to blocks by a hash. A block sends, for each range of keys, one row with its own
distinct keys packed as a binary array (a key held by a third of all documents is thus sent once a
block). The reducer of a range sorts what it got and answers each block with the keys that concern
it. Blocks are cogrouped with their answers. A key range and a block have a bounded size, so no task
sees an unbounded group; nothing is collected to the driver but one row of sizes.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
MIN_BLOCKS = 128
SENT = "bucket int, p int, keys binary, own binary"
ANSWER = "p int, keys binary, own binary"


def shared_dir(spark: SparkSession) -> str:
    """A folder for one run under spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints/tessera"  # one machine, as in tests
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this run through Hadoop's file system, so it works on any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that nothing refers to any more, and the driver give memory back.

    Spark learns of them when the driver collects its garbage, which may be long after many of them lie on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, that no column of df has (in any case of letters)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def blocks_for(size: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(MIN_BLOCKS, -(-size // block_bytes))


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]


def dealt(docs: DataFrame, doc_id: str, text: str, n_blocks: int) -> DataFrame:
    """(p, doc_id, text): documents with their block. Equal ids with different texts are spread too."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(n_blocks)).cast("int").alias("p"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
    )


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def u64(b) -> np.ndarray:
    return np.frombuffer(b or b"", dtype=np.uint64)


def i64(b) -> np.ndarray:
    return np.frombuffer(b or b"", dtype=np.int64)


def sent_rows(p: int, keys: np.ndarray, own: np.ndarray | None, n_buckets: int, second: np.ndarray | None = None) -> pa.Table:
    """keys sorted; rows of one block by key range. With `second`, keys are 128 bits wide."""
    bucket = range_of(keys, n_buckets)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, int)
    ends = np.r_[at[1:], len(keys)]
    body = [pack(keys[i:j]) + (pack(second[i:j]) if second is not None else b"") for i, j in zip(at, ends, strict=False)]
    ids = [pack(own[i:j]) if own is not None else None for i, j in zip(at, ends, strict=False)]
    return pa.table(
        {
            "bucket": pa.array(bucket[at].astype(np.int32)),
            "p": pa.array(np.full(len(at), p, dtype=np.int32)),
            "keys": pa.array(body, pa.binary()),
            "own": pa.array(ids, pa.binary()),
        }
    )


def range_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The key range of each key: its top 32 bits scaled to n_buckets."""
    return (((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)


def p_of(table: pa.Table) -> int:
    return table["p"][0].as_py()


def shared_keys(sent: DataFrame) -> DataFrame:
    """Answers each block with those of its keys that some other block sent too."""

    def reduce(table: pa.Table) -> pa.Table:
        ps = table["p"].to_numpy()
        each = [u64(b) for b in table["keys"].to_pylist()]
        keys = np.concatenate(each)
        keys.sort()
        twice = keys[:-1][keys[1:] == keys[:-1]]
        twice = twice[np.r_[True, twice[1:] != twice[:-1]]] if len(twice) else twice
        out = [(int(p), pack(k[_in(k, twice)])) for p, k in zip(ps, each, strict=True)]
        out = [x for x in out if x[1]]
        return pa.table({"p": pa.array([x[0] for x in out], pa.int32()), "keys": pa.array([x[1] for x in out], pa.binary()), "own": pa.array([None] * len(out), pa.binary())})

    return sent.groupBy("bucket").applyInArrow(reduce, ANSWER)


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def first_owners(sent: DataFrame) -> DataFrame:
    """Answers each block with its 128-bit keys whose smallest owner lies in another block, and that owner."""

    def reduce(table: pa.Table) -> pa.Table:
        ps = table["p"].to_numpy()
        h1, h2, own, who = gather(table)
        return answers(ps, h1, h2, own, who)

    return sent.groupBy("bucket").applyInArrow(reduce, ANSWER)


def gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h1, h2, own, who = [], [], [], []
    for i, (k, o) in enumerate(zip(table["keys"].to_pylist(), table["own"].to_pylist(), strict=True)):
        k = u64(k)
        n = len(k) // 2
        h1.append(k[:n])
        h2.append(k[n:])
        own.append(i64(o))
        who.append(np.full(n, i, dtype=np.int32))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h1, h2, own, who))


def answers(ps: np.ndarray, h1: np.ndarray, h2: np.ndarray, own: np.ndarray, who: np.ndarray) -> pa.Table:
    by = np.lexsort((own, h2, h1))
    h1, h2, own, who = h1[by], h2[by], own[by], who[by]
    head = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(h1) else np.zeros(0, bool)
    least = own[np.flatnonzero(head)][np.cumsum(head) - 1] if len(h1) else own
    late = np.flatnonzero(own > least)
    order = late[np.argsort(who[late], kind="stable")]
    w = who[order]
    at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, int)
    ends = np.r_[at[1:], len(w)]
    return pa.table(
        {
            "p": pa.array([int(ps[w[i]]) for i in at], pa.int32()),
            "keys": pa.array([pack(h1[order[i:j]]) for i, j in zip(at, ends, strict=False)], pa.binary()),
            "own": pa.array([pack(least[order[i:j]]) for i, j in zip(at, ends, strict=False)], pa.binary()),
        }
    )


def reply_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All answers for a block: sorted keys and owners."""
    k = [u64(b) for b in table["keys"].to_pylist()]
    o = [i64(b) for b in table["own"].to_pylist()]
    keys = np.concatenate(k) if k else np.zeros(0, np.uint64)
    own = np.concatenate(o) if o else np.zeros(0, np.int64)
    by = np.argsort(keys, kind="stable")
    return keys[by], own[by] if len(own) else own


def with_answers(blocks: DataFrame, answer: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(documents of a block, answers for it). Blocks without documents have no answers."""
    return blocks.groupBy("p").cogroup(answer.groupBy("p")).applyInArrow(work, schema)
