"""Line dedup (operator 8): levelled sorted runs of line hashes, merge-anti-joined by each new batch.

An index is a folder of runs and a manifest. A run holds, in one file for each range of keys, sorted 128-bit
hashes of line keys and the document that holds each first. A new batch of documents is hashed and sorted;
each range is merged with the files of its own range in every run (binary search of one sorted list in the
other: runs are never shuffled or sorted again), and the keys that no run knows become a new run of level 0. When
`fanout` runs stand on a level they are merged into one of the next level, so n batches leave
O(fanout * log n) runs.

Runs are never changed in place, every attempt writes under new names, and the manifest is replaced as a whole
when all is written: a failed batch leaves the index as it was and can be given again, and `LineIndex` on
the same folder goes on where the last one stopped, with the parameters in the manifest.

Rules: a line's key is the line with white space [\\x20\\x09-\\x0D] stripped at both ends and A-Z
lower-cased. A key of `min_chars` code points or more loses its lines in all documents but the one
that came first: of an earlier batch or, within a batch, of the smallest doc_id (null: the largest).
Rows that share a doc_id keep each other's lines within a batch. Null or empty text is one empty line. Lines
repeated within the keeping document stay. A very long text is a block of its own. An empty table gives no rows
and leaves the index as it is. Extra columns are ignored. Runs compare 128 bits; the answer to a block
names a key by the first 64 of them, which are unique among the keys of a block but for a chance of n * n / 2**65.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce as fold

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import textvec as V
from .files import exists, get, put
from .substring_dedup import NO_ID, ids_of

MANIFEST = "manifest.json"
EARLIER = np.iinfo(np.int64).min  # holder of keys that an earlier batch had


class Lines:
    """Lines of a batch of texts with the 128-bit hashes of their keys; keys too short have live False."""

    def __init__(self, texts: V.Texts, min_chars: int):
        data, off = texts.data, texts.offsets
        nl = np.flatnonzero(data == 10)
        doc = np.r_[np.arange(len(texts)), np.searchsorted(off, nl, side="right") - 1]
        start = np.r_[off[:-1], nl + 1]
        by = np.lexsort((start, doc))
        self.doc, self.start = doc[by], start[by]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.end = np.r_[self.start[1:] - 1, 0]
        last = self.first[1:] - 1
        self.end[last] = off[1:]
        w = V.words(texts)
        a, z = np.searchsorted(w.starts, self.start), np.searchsorted(w.starts, self.end)
        some = z > a
        lo, hi = np.zeros(len(self.start), np.int64), np.zeros(len(self.start), np.int64)
        lo[some], hi[some] = w.starts[a[some]], w.ends[z[some] - 1]
        chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        self.live = chars[hi] - chars[lo] >= min_chars
        at = np.flatnonzero(self.live)
        small = V.LOWER[data]
        self.h1, self.h2 = (np.zeros(len(lo), np.uint64) for _ in range(2))
        self.h1[at] = V.spans_hash(small, lo[at], hi[at], 0)
        self.h2[at] = V.spans_hash(small, lo[at], hi[at], 1)


def hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """(p, doc_id, keys): the live line keys of each document, 16 bytes each; the text is not shuffled."""

    def work(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            texts = V.Texts.of(t["text"])
            for i, j in V.slices(texts, 4 << 20):
                x = Lines(V.part(texts, i, j), min_chars)
                live = np.flatnonzero(x.live)
                cut = np.searchsorted(x.doc[live], np.arange(j - i + 1))
                keys = [X.pack(x.h1[live[a:b]]) + X.pack(x.h2[live[a:b]]) for a, b in zip(cut, cut[1:], strict=False)]
                part = t.slice(i, j - i)
                yield from pa.table({"p": part["p"], "doc_id": part["doc_id"], "keys": pa.array(keys, pa.binary())}).to_batches()

    return docs.mapInArrow(work, "p int, doc_id long, keys binary").where(F.octet_length("keys") > 0)


def send(n_buckets: int):
    def work(table: pa.Table) -> pa.Table:
        ids = ids_of(table)
        each = [X.u64(b) for b in table["keys"].to_pylist()]
        h1, h2 = (np.concatenate([k[: len(k) // 2] if half == 0 else k[len(k) // 2 :] for k in each]) for half in (0, 1))
        own = np.repeat(ids, [len(k) // 2 for k in each])
        by = np.lexsort((own, h2, h1))
        h1, h2, own = h1[by], h2[by], own[by]
        head = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        return X.sent_rows(X.p_of(table), h1[head], own[head], n_buckets, h2[head])

    return work


def lookup(run: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which of the sorted keys (h1, h2) a run holds."""
    n = len(run) // 3
    r1, r2 = run[:n], run[n : 2 * n]
    at = np.searchsorted(r1, h1)
    found, todo = np.zeros(len(h1), bool), np.arange(len(h1))
    while len(todo):  # past keys that share the first half only
        todo = todo[at[todo] < n]
        todo = todo[r1[at[todo]] == h1[todo]]
        same = r2[at[todo]] == h2[todo]
        found[todo[same]] = True
        todo = todo[~same]
        at[todo] += 1
    return found


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One sorted run from two that hold no key in common."""
    a, b = a.reshape(3, -1), b.reshape(3, -1)
    out = np.empty((3, a.shape[1] + b.shape[1]), np.uint64)
    at = np.searchsorted(a[0], b[0]) + np.arange(b.shape[1])
    rest = np.ones(out.shape[1], bool)
    rest[at] = False
    out[:, at], out[:, rest] = b, a
    return out.ravel()


def run_of(folder: str, bucket: int) -> np.ndarray:
    """h1, h2 and owners (as bits) of a range; a run without such a file holds none."""
    return get(folder, f"{bucket}.run", "<u8") if exists(folder, f"{bucket}.run") else np.zeros(0, np.uint64)


def settle(runs: list[str], new: str):
    """Merge-anti-join of a batch's keys of one range with the runs: answers to blocks; the rest is written to the run `new`."""

    def work(sent: pa.Table) -> pa.Table:
        bucket, ps = sent["bucket"][0].as_py(), sent["p"].to_numpy()
        h1, h2, own, who = X.gather(sent)
        by = np.lexsort((own, h2, h1))
        h1, h2, own, who = h1[by], h2[by], own[by], who[by]
        head = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        group = np.cumsum(head) - 1
        k1, k2, first = h1[head], h2[head], own[head]
        known = np.zeros(len(k1), bool)
        for folder in runs:
            left = np.flatnonzero(~known)
            known[left] = lookup(run_of(folder, bucket), k1[left], k2[left])
        fresh = ~known
        put(new, f"{bucket}.run", k1[fresh].astype("<u8"), k2[fresh].astype("<u8"), first[fresh].astype("<i8"))
        holder = np.where(known, EARLIER, first)[group]
        late = np.flatnonzero(known[group] | (own > first[group]))
        late = late[np.argsort(who[late], kind="stable")]
        w = who[late]
        at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, int)
        ends = np.r_[at[1:], len(w)]
        return pa.table(
            {
                "p": pa.array([int(ps[w[i]]) for i in at], pa.int32()),
                "keys": pa.array([X.pack(h1[late[i:j]]) for i, j in zip(at, ends, strict=False)], pa.binary()),
                "own": pa.array([X.pack(holder[late[i:j]]) for i, j in zip(at, ends, strict=False)], pa.binary()),
            }
        )

    return work


def compacted(runs: list[str], to: str):
    """Ranges to one row each, when their files of all runs are merged into one."""

    def work(batches):
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                each = sorted((run_of(x, bucket) for x in runs), key=len)
                put(to, f"{bucket}.run", fold(merge, each).astype("<u8"))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64())})

    return work


class LineIndex:
    """Levelled runs under `path`; `levels[i]` lists the runs of level i. A manifest there is taken up, with its parameters."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 64, fanout: int = 3, min_chars: int = 10):
        self.spark, self.path = spark, path
        self.n_buckets, self.fanout, self.min_chars = n_buckets, fanout, min_chars
        self.levels: list[list[str]] = [[]]
        if exists(path, MANIFEST):
            self.__dict__.update(json.loads(get(path, MANIFEST, np.uint8).tobytes()))

    def _commit(self, levels: list[list[str]]) -> None:
        put(self.path, MANIFEST, json.dumps({"levels": levels, "n_buckets": self.n_buckets, "fanout": self.fanout, "min_chars": self.min_chars}).encode())
        self.levels = levels

    def runs(self) -> list[str]:
        return [f"{self.path}/{x}" for level in self.levels for x in level]

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_blocks: int | None = None, keep_text: bool = True) -> DataFrame:
        """Settle one batch against the index, add its run, and return its documents without repeated lines."""
        n_blocks = n_blocks or X.blocks_for(X.text_bytes(docs, text))
        blocks = X.dealt(docs, doc_id, text, n_blocks)
        sent = hashed(blocks, self.min_chars).groupBy("p").applyInArrow(send(self.n_buckets), X.SENT)
        name = f"run-{uuid.uuid4().hex}"
        step = f"{self.path}/answers-{name}"
        sent.groupBy("bucket").applyInArrow(settle(self.runs(), f"{self.path}/{name}"), X.ANSWER).write.parquet(step)
        self._commit([[*self.levels[0], name], *self.levels[1:]])
        self._compact()
        return cut(blocks, self.spark.read.schema(X.ANSWER).parquet(step), self.min_chars, keep_text)

    def _compact(self) -> None:
        i = 0
        while i < len(self.levels):
            level = self.levels[i]
            if len(level) >= self.fanout:
                name = f"run-{uuid.uuid4().hex}"
                ranges = self.spark.range(0, self.n_buckets, 1, self.n_buckets)
                ranges.mapInArrow(compacted([f"{self.path}/{x}" for x in level], f"{self.path}/{name}"), "bucket long").count()
                above = self.levels[i + 1] if i + 1 < len(self.levels) else []
                self._commit([*self.levels[:i], [], [*above, name], *self.levels[i + 2 :]])
                for x in level:
                    X.remove(self.spark, f"{self.path}/{x}")
            i += 1


def cut(blocks: DataFrame, answer: DataFrame, min_chars: int, keep_text: bool) -> DataFrame:
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * keep_text

    def finish(table: pa.Table, answer: pa.Table) -> pa.Table:
        texts, ids = V.Texts.of(table["text"]), ids_of(table)
        x = Lines(texts, min_chars)
        live = np.flatnonzero(x.live)
        keys, own, _ = V.owners(x.h1[live], ids[x.doc[live]])
        away, holder = X.reply_of(answer)
        if len(away):
            at = np.searchsorted(keys, away)
            at[at == len(keys)] = 0
            same = keys[at] == away
            np.minimum.at(own, at[same], holder[same])
        gone = np.zeros(len(x.start), bool)
        if len(live):
            gone[live] = own[np.searchsorted(keys, x.h1[live])] < ids[x.doc[live]]
        dropped = np.add.reduceat(gone.astype(np.int64), x.first[:-1]) if len(texts) else np.zeros(0, np.int64)
        kept = []
        for i in range(len(texts)):
            a, b = x.first[i], x.first[i + 1]
            if dropped[i]:
                kept.append(b"\n".join(texts.data[x.start[j] : x.end[j]].tobytes() for j in range(a, b) if not gone[j]))
            else:
                kept.append(texts.doc(i).tobytes())
        out = {"doc_id": table["doc_id"], "n_lines": pa.array(np.diff(x.first), pa.int64()), "n_dropped": pa.array(dropped), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if keep_text:
            out["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table(out)

    return X.with_answers(blocks, answer, finish, schema)


def line_dedup(docs: DataFrame, n_batches: int = 4, fanout: int = 3, min_chars: int = 10, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """All documents, in `n_batches` ranges of doc_id from small to large, through one index."""
    spark = docs.sparkSession
    ends = docs.agg(F.percentile_approx(doc_id, [i / n_batches for i in range(1, n_batches)], 10000)).first()[0] if n_batches > 1 else None
    ends = sorted(set(ends or []))
    c = F.col(doc_id)
    edges = [None, *ends, None]
    batches = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        ok = F.lit(True) if lo is None else (c > lo) | c.isNull() if hi is None else c > lo
        batches.append(docs.where(ok if hi is None else ok & (c <= hi)))
    n = X.blocks_for(X.text_bytes(docs, text) // len(batches))
    index = LineIndex(spark, X.shared_dir(spark), fanout=fanout, min_chars=min_chars, n_buckets=max(32, n // 2))
    return fold(DataFrame.unionByName, [index.add(b, doc_id, text, n, keep_text) for b in batches])


__all__ = ["LineIndex", "line_dedup", "NO_ID"]
