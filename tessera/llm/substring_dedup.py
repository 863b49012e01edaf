"""Substring dedup (operator 1): difference-cover anchors, extended to exact windows.

A difference cover D of the residues modulo v holds, for every shift, a pair of residues that far
apart. So for any two positions i, j there is a delta < v with both i + delta and j + delta on the
cover. Hashing k-word anchors at cover positions only, with k = window - v + 1, therefore keeps one
aligned anchor inside every shared window wherever it stands in either document. Anchors that no
second document holds rule their windows out; windows around the others are hashed in full (128 bits)
and the smallest document holding each is found by an owner exchange.

Rules: a word is removed if some window of `window` consecutive words covering it also starts in a
document with a smaller doc_id. Windows are judged on the input. Null texts have no words; texts
shorter than a window lose nothing; a null doc_id counts as larger than any other; rows with equal
doc_id don't remove each other's words. Ties can't arise: the smallest doc_id keeps a window wherever it stands. A very
long text is a block of its own; an empty table gives no rows. Extra columns are ignored, so their names can't clash.
Windows compare 128 bits between blocks; an answer names a window of a block by the first 64 of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import textvec as V

#: Perfect difference sets by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
NO_ID = np.iinfo(np.int64).max


def period_for(window: int) -> int:
    """The largest period that leaves anchors of at least half a window."""
    fit = [v for v in COVERS if window - v + 1 >= (window + 1) // 2]
    if not fit:
        raise ValueError("windows of 4 words or more are needed")
    return max(fit)


def ids_of(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(NO_ID).to_numpy()


class Block:
    """Words and hashes of the documents of one block."""

    def __init__(self, table: pa.Table, separators: np.ndarray = V.SPACE):
        self.ids = ids_of(table)
        self.texts = V.Texts.of(table["text"])
        self.words = V.words(self.texts, separators)
        self.n = len(self.words.starts)
        self.doc = self.ids[self.words.docs()]
        self._hash: dict[int, np.ndarray] = {}

    def hash(self, seed: int = 0) -> np.ndarray:
        if seed not in self._hash:
            self._hash[seed] = V.spans_hash(self.texts.data, self.words.starts, self.words.ends, seed)
        return self._hash[seed]

    def within(self) -> np.ndarray:
        """Position of each word in its document."""
        return np.arange(self.n) - np.repeat(self.words.first[:-1], self.words.counts())


def cover_anchors(b: Block, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and hashes of the anchors, and their length."""
    v = period_for(window)
    k = window - v + 1
    fits = V.window_starts(b.words.first, k, b.n)
    on = np.zeros(v, dtype=bool)
    on[list(COVERS[v])] = True
    at = np.flatnonzero(fits & on[b.within() % v])
    return at, V.window_hash(b.hash(), k)[at], k


def near_anchor(b: Block, at: np.ndarray, k: int, window: int) -> np.ndarray:
    """Starts of windows that hold one of the anchors at `at`, as a mask."""
    mark = np.zeros(b.n + 1, dtype=np.int32)
    np.add.at(mark, np.maximum(at - (window - k), 0), 1)
    np.add.at(mark, at + 1, -1)
    return (np.cumsum(mark[:-1]) > 0) & V.window_starts(b.words.first, window, b.n)


def send_anchors(anchors, window: int, n_buckets: int):
    """Step A: the distinct anchors of a block."""

    def work(table: pa.Table) -> pa.Table:
        _, keys, _ = anchors(Block(table), window)
        return X.sent_rows(X.p_of(table), np.unique(keys), None, n_buckets)

    return work


def send_windows(anchors, window: int, n_buckets: int):
    """Step B: windows around anchors that two documents share, with the block's smallest owner."""

    def work(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.sent_rows(0, np.zeros(0, np.uint64), None, n_buckets)
        b = Block(table)
        at, keys, k = anchors(b, window)
        shared, _ = X.reply_of(answer)
        own_keys, _, several = V.owners(keys, b.doc[at])
        hit = V.member(keys, shared) | V.member(keys, own_keys[several])
        starts = np.flatnonzero(near_anchor(b, at[hit], k, window))
        return distinct_windows(b, starts, window, X.p_of(table), n_buckets)

    return work


def distinct_windows(b: Block, starts: np.ndarray, window: int, p: int, n_buckets: int) -> pa.Table:
    """The distinct windows at `starts` by key range, each with its smallest document."""
    h1, h2 = (V.window_hash(b.hash(s), window, s)[starts] for s in (0, 1))
    by = np.lexsort((b.doc[starts], h2, h1))
    h1, h2, own = h1[by], h2[by], b.doc[starts][by]
    head = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(h1) else np.zeros(0, bool)
    return X.sent_rows(p, h1[head], own[head], n_buckets, h2[head])


def seen_before(b: Block, answer: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Step C: mask of windows that start in a smaller document too, and the smallest owner of each window."""
    fits = np.flatnonzero(V.window_starts(b.words.first, window, b.n))
    h = V.window_hash(b.hash(), window)[fits]
    keys, own, _ = V.owners(h, b.doc[fits])
    away, least = X.reply_of(answer)
    if len(away):
        at = np.searchsorted(keys, away)
        at[at == len(keys)] = 0
        same = keys[at] == away
        own = own.copy()
        np.minimum.at(own, at[same], least[same])
    first = own[np.searchsorted(keys, h)] if len(h) else own
    hit = np.zeros(b.n, dtype=bool)
    owner = np.full(b.n, NO_ID, dtype=np.int64)
    late = first < b.doc[fits]
    hit[fits[late]] = True
    owner[fits[late]] = first[late]
    return hit, owner


def kept_text(b: Block, i: int, gone: np.ndarray) -> bytes:
    w = slice(b.words.first[i], b.words.first[i + 1])
    data = b.texts.data
    return b" ".join(data[s:e].tobytes() for s, e in zip(b.words.starts[w][~gone[w]], b.words.ends[w][~gone[w]], strict=True))


def rounds(docs: DataFrame, doc_id: str, text: str, window: int, anchors) -> tuple[DataFrame, DataFrame]:
    """(blocks, answers): documents by block and, for each block, the windows another block holds first."""
    size = X.text_bytes(docs, text)
    n = X.blocks_for(size)
    blocks = X.dealt(docs, doc_id, text, n)
    shared = X.shared_keys(blocks.groupBy("p").applyInArrow(send_anchors(anchors, window, n // 2), X.SENT))
    sent = X.with_answers(blocks, shared, send_windows(anchors, window, n // 2), X.SENT)
    return blocks, X.first_owners(sent)


def substring_dedup(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with keep_text the kept words joined by spaces (`kept`)."""
    period_for(window)
    blocks, answer = rounds(docs, doc_id, text, window, cover_anchors)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    def finish(table: pa.Table, answer: pa.Table) -> pa.Table:
        b = Block(table)
        gone = V.covered(seen_before(b, answer, window)[0], window)
        removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), b.words.first[:-1]) if len(b.texts) else np.zeros(0, np.int64)
        removed[b.words.counts() == 0] = 0
        kept = [kept_text(b, i, gone) for i in range(len(b.texts))]
        out = {
            "doc_id": table["doc_id"],
            "n_words": pa.array(b.words.counts().astype(np.int64)),
            "n_removed": pa.array(removed),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        if keep_text:
            out["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table(out)

    return X.with_answers(blocks, answer, finish, schema)
