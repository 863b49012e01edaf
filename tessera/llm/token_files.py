"""Token-ID output (operator 3): flat unsigned integers, 64-bit offsets, memory-mapped reading.

Format of a data set under one folder: for each partition `<name>.bin` holds token ids as little-endian
uint16, or uint32 where the vocabulary has more than 65,536 ids; `<name>.idx` holds int64 values: the
number of documents n, n doc_ids, and n + 1 offsets in tokens. Partitions are ranges of doc_id; the base
of a partition is the prefix sum of the token counts before it. The manifest is a Parquet table in the
same folder, one row a partition with its base, made by running sums within chunks of partitions and over the chunks'
totals; the driver sees none of it. Files are written under another name and renamed, so a lost executor's
half-written file is never read, and the manifest names one file for each partition.

The encoder cuts a byte-level text where its pre-tokeniser always cuts, hashes the pieces, encodes each
distinct piece once with the tokenizers library and gathers ids by piece. Texts with white space beyond
ASCII are encoded whole.

Rules: null texts are empty; each document, empty ones too, ends with `end_id`; null doc_ids come first; rows that share a
doc_id stand beside each other in the order of their texts (all in one partition). A very long text is encoded in one
piece. An empty table gives no files and an empty index. Extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import exchange as X
from . import textvec as V
from .files import get, put

NULL_ID = np.iinfo(np.int64).min
CACHE_PIECES = 400_000
PARTITION_BYTES = 16 << 20
# White space beyond ASCII, as UTF-8: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
_FAR_SPACES = "\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Encoder:
    """Byte-level BPE with the GPT-2 split, piece by piece."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab = self.tok.get_vocab_size()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.keys = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def cuts(t: V.Texts) -> np.ndarray:
        """Starts of pieces: places where the pre-tokeniser cuts whatever surrounds them."""
        d, off = t.data, t.offsets
        n = len(d)
        if not n:
            return np.zeros(0, np.int64)
        head = np.zeros(n + 1, bool)
        head[off] = True
        ws = V.SPACE[d]
        prev = np.r_[False, ws[:-1]]
        prev_b = np.r_[np.uint8(0), d[:-1]]
        nxt_ws = np.r_[ws[1:], True]
        nxt_ws[off[1:][off[1:] > 0] - 1] = True  # the end of a text ends its run whole
        cut = head[:n].copy()
        cut |= ws & ~prev
        cut |= ~ws & prev & (prev_b != 32)
        cut |= ws & prev & ~nxt_ws  # the last of a run may belong to the word after it
        cut |= _PUNCT[d] & _ALNUM[prev_b]
        return np.flatnonzero(cut)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        t = V.Texts.of(column)
        odd = self._odd(column)
        if odd.any():
            each = [np.zeros(0, np.uint32)] * len(t)
            plain = np.flatnonzero(~odd)
            if len(plain):
                ids, first = self(column.take(pa.array(plain)))
                for k, i in enumerate(plain):
                    each[i] = ids[first[k] : first[k + 1]]
            rows = np.flatnonzero(odd)
            for i, ids in zip(rows, self.encode(column.take(pa.array(rows)).to_pylist()), strict=True):
                each[i] = np.array(ids, np.uint32)
            return np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]
        starts = self.cuts(t)
        ends = np.r_[starts[1:], len(t.data)]
        h = V.spans_hash(t.data, starts, ends)
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        check = V.spans_hash(t.data, starts[np.sort(at)], ends[np.sort(at)], 1)[np.argsort(np.argsort(at))] if len(at) else h
        count, gather = self._lookup(t, keys, check, starts[at], ends[at])
        n = count[back]
        total = np.cumsum(n)
        out_first = total - n
        pool, pool_first = gather
        src = np.repeat(pool_first[back] - out_first, n) + np.arange(int(n.sum()))
        piece = np.searchsorted(starts, t.offsets)
        return pool[src], np.r_[0, total][piece]

    def _odd(self, column: pa.Array) -> np.ndarray:
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(column, f"[{_FAR_SPACES}\\x1c-\\x1f]")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(column, s))
        return odd.to_numpy(zero_copy_only=False)

    def _lookup(self, t: V.Texts, keys, check, starts, ends):
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = (self.keys[at] == keys) & (self.check[at] == check) if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        ids = self.encode([t.data[starts[i] : ends[i]].tobytes().decode() for i in new]) if len(new) else []
        size = np.array([len(x) for x in ids], np.int64)
        fresh = np.fromiter((y for x in ids for y in x), np.uint32, int(size.sum()))
        pool = np.r_[self.ids, fresh]
        count, first = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        width = np.diff(self.first)
        count[known], first[known] = width[at[known]], self.first[:-1][at[known]]
        count[new], first[new] = size, len(self.ids) + np.cumsum(size) - size
        if len(new) and len(self.keys) < CACHE_PIECES:
            k, c, w, f = np.r_[self.keys, keys[new]], np.r_[self.check, check[new]], np.r_[width, size], np.r_[self.first[:-1], first[new]]
            by = np.argsort(k, kind="stable")
            k, c, w, f = k[by], c[by], w[by], f[by]
            self.keys, self.check = k, c
            self.first = np.r_[0, np.cumsum(w)]
            self.ids = pool[np.repeat(f - self.first[:-1], w) + np.arange(int(w.sum()))]
        return count, (pool, first)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a process, with its pieces."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


MANIFEST = "part int, name string, low long, n_docs long, n_tokens long, width int, base long"
CHUNK = 1024


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the data set with its manifest (part, name, low, n_docs, n_tokens, width, base; parts in order of doc_id)."""
    size = X.text_bytes(docs, text)
    n = max(16, -(-size // PARTITION_BYTES))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))

    def work(batches):
        enc = encoder(tokenizer)
        kind = np.dtype("<u2" if max(enc.vocab, end_id + 1) <= 1 << 16 else "<u4")
        ids, offsets, body, base = [], [np.zeros(1, np.int64)], [], 0
        for batch in batches:
            texts = batch.column("text").fill_null("")
            ids.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy())
            for i, j in V.slices(V.Texts.of(texts), 4 << 20):
                tokens, first = enc(texts.slice(i, j - i))
                # the end id behind each document
                out_first = first + np.arange(len(first))
                full = np.full(len(tokens) + j - i, end_id, kind)
                full[np.arange(len(tokens)) + np.repeat(np.arange(j - i), np.diff(first))] = tokens
                body.append(full)
                offsets.append(out_first[1:] + base)
                base += len(full)
        n_docs = sum(map(len, ids))
        if n_docs:
            name = f"part-{uuid.uuid4().hex}"
            put(out, f"{name}.bin", *body)
            put(out, f"{name}.idx", np.array([n_docs], "<i8"), np.concatenate(ids), np.concatenate(offsets))
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "low": pa.array([int(ids[0][0])], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([base], pa.int64()), "width": pa.array([kind.itemsize], pa.int32())})

    written = rows.mapInArrow(work, "part int, name string, low long, n_docs long, n_tokens long, width int")
    written.write.mode("overwrite").parquet(f"{out}/parts")
    parts = docs.sparkSession.read.schema("part int, name string, low long, n_docs long, n_tokens long, width int").parquet(f"{out}/parts")
    chunk = F.floor(F.col("part") / CHUNK)
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    chunks = parts.groupBy(chunk.alias("chunk")).agg(F.sum("n_tokens").alias("n"))  # one row for each CHUNK partitions
    chunks = chunks.select("chunk", F.coalesce(F.sum("n").over(before([], "chunk")), F.lit(0)).alias("start"))
    based = parts.withColumn("chunk", chunk).withColumn("inner", F.coalesce(F.sum("n_tokens").over(before(["chunk"], "part")), F.lit(0))).join(chunks, "chunk")
    based.select("part", "name", "low", "n_docs", "n_tokens", "width", (F.col("start") + F.col("inner")).alias("base")).write.mode("overwrite").parquet(f"{out}/manifest")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names."""
    rows = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").select("name", "n_docs", "base", "width")

    def work(batches):
        for batch in batches:
            for name, n, base, width in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                head = get(out, f"{name}.idx", "<i8")
                ids, offset = head[1 : n + 1], head[n + 1 :]
                body = get(out, f"{name}.bin", f"<u{width}")
                crc = [zlib.crc32(body[a:b].astype("<u4").tobytes()) for a, b in zip(offset[:-1], offset[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.array(ids), mask=np.array(ids) == NULL_ID), "start": pa.array(offset[:-1] + base), "n_tokens": pa.array(np.diff(offset)), "ids_crc32": pa.array(crc, pa.int64())})

    n_parts = max(1, rows.count())
    return rows.repartition(n_parts, "name").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, out: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs as token files and return their index, read back from the files."""
    spark = docs.sparkSession
    out = out or X.shared_dir(spark)
    write_tokens(docs, out, tokenizer, end_id, doc_id, text)
    return read_tokens(spark, out)
