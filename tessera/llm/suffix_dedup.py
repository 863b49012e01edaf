"""Suffix dedup (operator 2): a sparse suffix array over content-selected positions, spread over the cluster.

A suffix is retained where the hash of its first `head` words is the smallest of the heads in some
window of `min_words` words, so any shared passage of `min_words` words retains its suffixes at the
same places in both documents. A suffix is written as its first `min_words` words, two bytes a word, and
the suffixes of all documents are dealt by range and sorted in this order of their words; a block of documents
sends equal ones once, and a range can be cut anywhere, so a frequent beginning is spread over tasks. In
the sorted order a suffix shares the longest beginning with one of its two neighbours: their common prefix
is how far a match can be extended to the right. Suffixes next to the edge of a task count as matching in full.

Suffixes whose match holds their head are extended in their documents, to the right by the common
prefix and to the left up to a passage of `min_words` words. Two bytes a word can only make a prefix too long,
and the neighbour need not share what stands to the left, so an exact check follows: windows of
`min_words` words inside the extended matches are compared by 128-bit hashes (owner exchange), and
overlapping windows run together to maximal passages.

Rules: one row for each maximal run of words that some document with a smaller doc_id already holds
in windows of `min_words` words: doc_id, start_word, n_words, first_doc_id (the smallest document
holding the run's first window). Null, empty and short texts give no rows, nor does an empty table; a very long
text is a block of its own. A null doc_id counts as larger than any other; rows with equal doc_id don't match each
other. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import textvec as V
from .substring_dedup import Block, distinct_windows, seen_before


#: Bytes of text whose suffixes make one range.
RANGE_BYTES = 8 << 20


def minimiser_suffixes(head: int):
    """Positions of the retained suffixes and the hashes of their heads."""

    def anchors(b: Block, min_words: int) -> tuple[np.ndarray, np.ndarray, int]:
        width = min_words - head + 1
        fits = V.window_starts(b.words.first, min_words, b.n)
        h = V.window_hash(b.hash(), head)
        if len(h) < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), head
        least = V.minima(h, width)
        least[~fits[: len(least)]] = 0  # windows that cross documents select nothing
        pad = np.zeros(width - 1, dtype=np.uint64)
        # the largest window minimum over a head equals the head iff some window selects it
        most = ~V.minima(~np.r_[pad, least, pad], width)
        at = np.flatnonzero((most[: len(h)] == h) & (h > 0))
        return at, h[at], head

    return anchors


def suffix_keys(b: Block, min_words: int, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of each retained suffix, its place among the distinct ones, distinct suffixes in order)."""
    at, _, _ = minimiser_suffixes(head)(b, min_words)
    word = np.maximum(b.hash() >> np.uint64(48), np.uint64(1)).astype(">u2")
    last = b.words.first[1:][b.words.docs()[at]]
    body = np.zeros((len(at), min_words), ">u2")
    for i in range(min_words):
        on = at + i < last
        body[on, i] = word[at[on] + i]
    key, place = np.unique(body.view(f"V{2 * min_words}").ravel() if len(at) else np.zeros(0, f"V{2 * min_words}"), return_inverse=True)
    return at, place, key


def retained(min_words: int, head: int):
    """Distinct suffixes of a block, and whether two of its documents hold them."""

    def work(table: pa.Table) -> pa.Table:
        b = Block(table)
        at, place, key = suffix_keys(b, min_words, head)
        _, _, several = V.owners(place.astype(np.int64), b.doc[at])
        return pa.table(
            {
                "key": pa.array(key.tolist(), pa.binary()),
                "p": pa.array(np.full(len(key), X.p_of(table), np.int32)),
                "k": pa.array(np.arange(len(key), dtype=np.int32)),
                "many": pa.array(several, pa.bool_()),
            }
        )

    return work


def common_prefix(body: np.ndarray) -> np.ndarray:
    """Words that each row shares with the next one."""
    apart = body[1:] != body[:-1]
    return np.where(apart.any(1), apart.argmax(1), body.shape[1])


def neighbours(min_words: int, head: int):
    """Sorted suffixes of a range to (p, places, prefixes): those that share their head or more with a neighbour."""

    def work(batches):
        body, p, k, many = np.zeros((0, min_words), ">u2"), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
        left = np.full(1, min_words)  # what stands before the range is not known
        for batch in batches:
            if not batch.num_rows:
                continue
            body = np.concatenate([body, np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u2").reshape(-1, min_words)])
            p, k, many = (np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in ((p, "p"), (k, "k"), (many, "many")))
            shared = common_prefix(body)
            yield from packed(p[:-1], k[:-1], many[:-1], np.maximum(np.r_[left, shared[:-1]], shared) if len(shared) else shared)
            left = shared[-1:] if len(shared) else left
            body, p, k, many = body[-1:], p[-1:], k[-1:], many[-1:]
        yield from packed(p, k, many, np.full(len(p), min_words))

    def packed(p, k, many, shared):
        shared = np.where(many, min_words, shared)
        at = np.flatnonzero(shared >= head)
        at = at[np.argsort(p[at], kind="stable")]
        if not len(at):
            return
        cut = np.flatnonzero(np.r_[True, p[at][1:] != p[at][:-1]])
        ends = np.r_[cut[1:], len(at)]
        yield pa.RecordBatch.from_pydict(
            {
                "p": pa.array(p[at][cut].astype(np.int32)),
                "k": pa.array([X.pack(k[at[i:j]].astype(np.int32)) for i, j in zip(cut, ends, strict=True)], pa.binary()),
                "r": pa.array([X.pack(shared[at[i:j]].astype(np.int32)) for i, j in zip(cut, ends, strict=True)], pa.binary()),
            }
        )

    return work


def send_matches(min_words: int, head: int, n_buckets: int):
    """Windows inside the matches, extended to both sides, with the block's smallest owner."""

    def work(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.sent_rows(0, np.zeros(0, np.uint64), None, n_buckets)
        b = Block(table)
        at, place, key = suffix_keys(b, min_words, head)
        right = np.zeros(len(key), np.int64)
        for k, r in zip(answer["k"].to_pylist(), answer["r"].to_pylist(), strict=True):
            np.maximum.at(right, np.frombuffer(k, np.int32), np.frombuffer(r, np.int32))
        right = right[place]
        at, right = at[right >= head], right[right >= head]
        mark = np.zeros(b.n + 1, np.int32)
        np.add.at(mark, np.maximum(at - (min_words - head), 0), 1)  # a window holds the head
        np.add.at(mark, np.maximum(at + right - min_words, -1) + 1, -1)  # and ends where the prefix does
        starts = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & V.window_starts(b.words.first, min_words, b.n))
        return distinct_windows(b, starts, min_words, X.p_of(table), n_buckets)

    return work


def suffix_dedup(docs: DataFrame, min_words: int = 45, head: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, n_words, first_doc_id of every passage that an earlier document holds."""
    if not 1 <= head < min_words:
        raise ValueError("head must be at least 1 and below min_words")
    size = X.text_bytes(docs, text)
    n = X.blocks_for(size)
    blocks = X.dealt(docs, doc_id, text, n)
    suffixes = blocks.groupBy("p").applyInArrow(retained(min_words, head), "key binary, p int, k int, many boolean")
    ordered = suffixes.repartitionByRange(max(32, size // RANGE_BYTES), "key").sortWithinPartitions("key")
    near = ordered.mapInArrow(neighbours(min_words, head), "p int, k binary, r binary")
    answer = X.first_owners(X.with_answers(blocks, near, send_matches(min_words, head, n // 2), X.SENT))

    def finish(table: pa.Table, answer: pa.Table) -> pa.Table:
        b = Block(table)
        hit, owner = seen_before(b, answer, min_words)
        gone = V.covered(hit, min_words)
        head_of = gone.copy()
        head_of[1:] &= ~gone[:-1]
        firsts = b.words.first[:-1][b.words.counts() > 0]
        head_of[firsts] = gone[firsts]
        starts = np.flatnonzero(head_of)
        stop = np.r_[False, gone[:-1] & (~gone[1:] | head_of[1:]), gone[-1:]] if b.n else np.zeros(0, bool)
        ends = np.flatnonzero(stop)
        doc = b.words.docs()[starts]
        return pa.table(
            {
                "doc_id": table["doc_id"].take(pa.array(doc)),
                "start_word": pa.array(starts - b.words.first[doc], pa.int64()),
                "n_words": pa.array(ends - starts, pa.int64()),
                "first_doc_id": pa.array(owner[starts], pa.int64()),
            }
        )

    return X.with_answers(blocks, answer, finish, "doc_id long, start_word long, n_words long, first_doc_id long")
