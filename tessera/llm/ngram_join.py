"""N-gram Jaccard join (operator 10): parity sketches, pigeonhole join per size band, verification.

A document's set of distinct word shingles is folded into a parity sketch: each shingle flips one bit,
so the Hamming distance of two sketches never exceeds the symmetric difference of the sets. Sets with
Jaccard >= t and at most `hi` shingles differ in at most d = floor((1 - t) / (1 + t) * 2 * hi) shingles,
hence in at most d bits. The sketch of a size band is cut into more than d / 2 groups, each of three parts
of 2**16 bits, so linked documents differ by at most one bit in some group and agree in two of its parts
(pigeonhole). Two parts are a segment; only the hash of its set bits is kept. A band has spare groups, so
linked documents agree in several segments, and each keeps back as many of its lightest segments (fewest
set bits) as leave one of the common ones sent by both: light segments agree by chance. Documents
also probe each higher band whose sizes can still link with theirs.

Equal segments are combined twice: within a batch of documents, which sends its smallest document for
each segment, and across batches. Both times a spanning forest of the documents that share segments goes
out (not all pairs), and its components are groups: linked documents always lie in one group. A group is
dealt to tiles of bounded documents and bytes, so a text is sent once. The texts of grouped documents are looked up
once and written; a broadcast bitmap of hashed ids keeps most others out of that shuffle. The task of a tile compares whole
sketches, verifies pairs whose Hamming distance allows a link on their sets, skips pairs that links found
before join already, and emits a forest of links: never pairs, never a text for a pair.

A group of one tile is done then. Larger ones are dealt `SWEEPS` times by different hashes; near copies end in
one component after that. The largest component of a group is its core. Every other document of the group still has to
be compared with all: sketches alone (a sixth of a text) are dealt so that tiles of these documents meet each
other and the tiles of the core, but no two tiles of the core meet. Pairs of different components whose sketches
allow a link are close; each component of close pairs is a small group, dealt as texts again and verified. So no
pair that could join two components is left out at any size of a group.

Rules: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text of fewer words than a shingle is one
shingle; null and empty texts have none and link with nothing; documents with null doc_id link with
nothing and have a null component. Rows that share a doc_id are one node: what links with either text
links with both, and each row has its own n_shingles. Ties are no matter, since links and smallest ids
need no order. A very long text fills a tile of its own. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textvec as V
from .graph import components

FOUND = "kind string, a binary, b binary"
BAND_RATIO = 1.3
#: Parts of a group; a segment is all of them but one.
PARTS = 3
#: One more group for so many groups.
SPARE = 8
#: Documents, and bytes of their texts, of one tile.
TILE = 4096
TILE_BYTES = 4 << 20
#: Dealings of a group of several tiles, before sketches of all its documents are compared.
SWEEPS = 2
#: Bytes of texts whose sketches make a tile, which has twice as many documents as one of texts.
SKETCH_TILE_BYTES = 48 << 20
#: Bytes of texts whose segments are combined at once.
BATCH_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).min
#: Bits a shingle of the sketches compared in tiles; wide ones lose few flips to collisions.
SHARP = 8
#: They are compared folded to this part of their width first.
FOLD = 4
#: Words of 64 bits, at most, of the bitmap that tells which documents are grouped. A fuller bitmap lets more texts pass to the join.
MASK_WORDS = 1 << 18


class Sets:
    """Distinct shingle hashes of each document of a batch, concatenated: h[first[i]:first[i + 1]]."""

    def __init__(self, texts: V.Texts, width: int):
        low = V.Texts(V.LOWER[texts.data], texts.offsets)
        w = V.words(low)
        item = V.spans_hash(low.data, w.starts, w.ends)
        n = w.counts()
        fits = np.flatnonzero(V.window_starts(w.first, width, len(item)))
        parts, docs = [V.window_hash(item, width)[fits]], [w.docs()[fits]]
        short = np.flatnonzero((n > 0) & (n < width))
        for k in np.unique(n[short]):
            rows = short[n[short] == k]
            parts.append(V.mix64(V.window_hash(item, int(k))[w.first[rows]] + np.uint64(k)))
            docs.append(rows)
        h, doc = np.concatenate(parts), np.concatenate(docs)
        by = np.lexsort((h, doc))
        h, doc = h[by], doc[by]
        head = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
        self.h, self.doc = h[head], doc[head]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.sizes = np.diff(self.first)

    def of(self, i: int) -> np.ndarray:
        return self.h[self.first[i] : self.first[i + 1]]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digest of each set."""
        out = []
        for salt in (0x51ED270B, 0x2545F491):
            p = np.r_[np.uint64(0), np.cumsum(V.mix64(self.h ^ np.uint64(salt)))]
            out.append(p[self.first[1:]] - p[self.first[:-1]])
        return out[0], out[1]


def bands(most: int) -> np.ndarray:
    """Lower ends of the size bands up to `most` shingles."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return np.array(out)


def band_plan(lows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of parts of each band for a threshold num / den, and how many of its keys a document may keep back.

    Of g groups more than half as many as the d possible differences, one at least has at most one difference.
    A group's first difference spoils all keys but one, its second the last; what the d differences can't spoil,
    less one key, may be kept back.
    """
    hi = lows[1:] - 1
    d = (den - num) * 2 * hi // (den + num)
    g = d // 2 + 1
    g = g + g // SPARE
    return g, np.where(d <= g, PARTS * g - (PARTS - 1) * d, 2 * g - d) - 1


def segment_keys(sets: Sets, rows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row) of the segments that the documents `rows` send: all parts but one of a group make one segment."""
    sizes = sets.sizes[rows]
    if not len(rows) or not sizes.max():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lows = bands(int(sizes.max()) * den // num + 1)
    count, spare = band_plan(lows, num, den)
    own = np.searchsorted(lows, sizes, side="right") - 1
    keys, who = [], []
    todo = rows[sizes > 0]
    band = own[sizes > 0]
    while len(todo):
        m = count[band] * PARTS
        base = np.cumsum(m) - m
        n = sets.sizes[todo]
        at = np.repeat(sets.first[todo] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        # the order of the hashes is that of the bits, so shingles of equal bits are neighbours
        bit = ((sets.h[at] >> np.uint64(32)) * np.repeat(m, n).astype(np.uint64)) >> np.uint64(16)
        bit += np.repeat(base, n).astype(np.uint64) << np.uint64(16)
        head = np.flatnonzero(np.r_[True, bit[1:] != bit[:-1]])
        bit = bit[head[(np.diff(np.r_[head, len(bit)]) & 1) == 1]]  # bits flipped an even number of times cancel
        part = (bit >> np.uint64(16)).astype(np.int64)
        acc, weight = np.zeros(int(m.sum()), np.uint64), np.bincount(part, minlength=int(m.sum()))
        if len(part):
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            acc[part[cut]] = np.bitwise_xor.reduceat(V.mix64((bit & np.uint64(0xFFFF)) + np.uint64(1)), cut)
        owner = np.repeat(np.arange(len(todo)), m)
        within = np.arange(len(acc)) - np.repeat(base, m)
        acc = V.mix64(acc + V.mix64((np.repeat(band, m).astype(np.uint64) << np.uint64(40)) + within.astype(np.uint64) + np.uint64(7)))
        # a segment leaves out the part of its own place
        whole = lambda x: np.repeat(x.reshape(-1, PARTS).sum(1, dtype=x.dtype), PARTS) - x
        acc, weight = V.mix64(whole(acc) + (within % PARTS).astype(np.uint64)), whole(weight)
        # the lightest are kept back: linked documents agree on their common segments, so on the order of these too
        by = np.lexsort((weight, owner))
        send = np.sort(by[within >= spare[band][owner]])
        keys.append(acc[send])
        who.append(todo[owner[send]])
        up = band + 1
        go = sets.sizes[todo] * den >= num * lows[np.minimum(up, len(lows) - 1)]
        go &= up < len(count)
        todo, band = todo[go], up[go]
    return np.concatenate(keys), np.concatenate(who)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that takes those found most often first."""
    if not len(a):
        return a, b
    pairs, often = np.unique(np.stack([a, b], 1), axis=0, return_counts=True)
    pairs = pairs[np.argsort(-often, kind="stable")]
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kept = []
    for i, (x, y) in enumerate(pairs.tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[y] = x
            kept.append(i)
    return pairs[kept, 0], pairs[kept, 1]


def stars(keys: np.ndarray, ids: np.ndarray):
    """Sorted (keys, smallest id) and a forest of pairs (smallest, other)."""
    by = np.lexsort((ids, keys))
    k, d = keys[by], ids[by]
    head = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    lead = d[at][np.cumsum(head) - 1] if len(k) else d
    rest = d != lead
    a, b = forest(lead[rest], d[rest])
    return k[at], d[at], a, b


def sketch(width: int, num: int, den: int, n_buckets: int):
    """Batches of documents to packed rows: segments by key range; sizes, copies and candidates at once."""

    def work(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            ids = t["doc_id"].fill_null(NO_ID).to_numpy()
            texts = V.Texts.of(t["text"])
            keys, who, size = [], [], 0
            for i, j in V.slices(texts, BATCH_BYTES // 4):
                s = Sets(V.part(texts, i, j), width)
                own = ids[i:j]
                yield row(-1, "size", b"", own, s.sizes)
                d1, d2 = s.digests()
                live = np.flatnonzero((s.sizes > 0) & (own != NO_ID))
                by = live[np.lexsort((own[live], d2[live], d1[live]))]
                head = np.r_[True, (d1[by][1:] != d1[by][:-1]) | (d2[by][1:] != d2[by][:-1])] if len(by) else np.zeros(0, bool)
                first = by[head]
                if (~head).any():
                    lead = own[first][np.cumsum(head) - 1]
                    yield row(-1, "link", b"", lead[~head], own[by][~head])
                k, r = segment_keys(s, first, num, den)
                keys.append(k)
                who.append(own[r])
                size += int(texts.offsets[j] - texts.offsets[i])
                if size >= BATCH_BYTES:
                    yield from combined(keys, who)
                    keys, who, size = [], [], 0
            if keys:
                yield from combined(keys, who)

    def combined(keys: list, who: list):
        k, d, a, b = stars(np.concatenate(keys), np.concatenate(who))
        if len(a):
            yield row(-1, "pair", b"", a, b)
        bucket = X.range_of(k, n_buckets)
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(k) else np.zeros(0, int)
        for x, y in zip(at, np.r_[at[1:], len(k)], strict=False):
            yield row(int(bucket[x]), "segment", X.pack(k[x:y]), d[x:y], d[:0])

    def row(bucket: int, kind: str, keys: bytes, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"bucket": pa.array([bucket], pa.int32()), "kind": [kind], "keys": pa.array([keys], pa.binary()), "a": pa.array([small(a)], pa.binary()), "b": pa.array([small(b)], pa.binary())}
        )

    return work


def small(x: np.ndarray) -> bytes:
    """Ids with a byte for their width, half as wide where they allow it."""
    if not len(x) or (x.min() >= -(1 << 31) and x.max() < 1 << 31):
        return b"\4" + x.astype(np.int32).tobytes()
    return b"\10" + x.astype(np.int64).tobytes()


def wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int32 if b[0] == 4 else np.int64, offset=1).astype(np.int64)


def meet(table: pa.Table) -> pa.Table:
    """Segments of one key range from all batches: candidates."""
    keys = [X.u64(b) for b in table["keys"].to_pylist()]
    ids = [wide(b) for b in table["a"].to_pylist()]
    _, _, a, b = stars(np.concatenate(keys), np.concatenate(ids))
    n = int(len(a) > 0)
    return pa.table({"kind": pa.array(["pair"] * n, pa.string()), "a": pa.array([small(a)] * n, pa.binary()), "b": pa.array([small(b)] * n, pa.binary())})


def unpack(batches):
    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            x, y = wide(a), wide(b)
            for i in range(0, len(x), 50_000):
                part = x[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"a": pa.array(part, mask=part == NO_ID), "b": pa.array(y[i : i + 50_000])})


def _sets(column, width: int) -> list[np.ndarray]:
    """One set for each row; equal texts are hashed once."""
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    texts = V.Texts.of(coded.dictionary)
    each = []
    for i, j in V.slices(texts, 2 << 20):
        s = Sets(V.part(texts, i, j), width)
        each += [s.of(k) for k in range(j - i)]
    return [each[i] for i in coded.indices.to_pylist()]


def parity(h: np.ndarray) -> bytes:
    """The parity sketch of a set, of SHARP times the first power of two above its size in bits."""
    n_bits = SHARP << max(5, len(h).bit_length())
    odd = np.bincount((h & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    # little order, so that folding the upper half onto the lower gives the sketch half as wide
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def link_tile(width: int, num: int, den: int):
    """Links between different components among the texts of each key of a tile, or between two tiles: a forest."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key, ids, c, t = (table[x].to_numpy() for x in ("key", "doc_id", "c", "t"))
        sets = _sets(table["text"], width)
        cross = table["x"][0].as_py() != table["y"][0].as_py()
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        found = []
        for i, j in zip(at, np.r_[at[1:], len(key)], strict=True):
            n = np.array([len(x) for x in sets[i:j]])
            found += _links([parity(x) for x in sets[i:j]], n, ids[i:j], c[i:j].copy(), t[i:j], cross, num, den, sets[i:j])
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return work


def near(raw: list[bytes], n, c, apart_: np.ndarray | None, num: int, den: int):
    """For each document, those after it (among sketches as wide, then twice as wide) of other components whose sketches allow a link."""
    width = np.array([len(x) for x in raw])
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        full = np.frombuffer(b"".join(raw[i] for i in rows), np.uint64).reshape(len(rows), -1)
        more = np.flatnonzero(width == 2 * w)  # sizes that link differ by less than a factor of two
        if len(more):
            big = np.frombuffer(b"".join(raw[i] for i in more), np.uint64).reshape(len(more), -1)
            half = big.shape[1] // 2
            full = np.concatenate([full, big[:, :half] ^ big[:, half:]])
        folded = np.bitwise_xor.reduce(full.reshape(len(full), FOLD, -1), 1)
        at = np.r_[rows, more]
        for i, me in enumerate(rows):
            o = at[i + 1 :]
            ok = (c[o] != c[me]) & (den * np.minimum(n[o], n[me]) >= num * np.maximum(n[o], n[me])) & (n[o] > 0)
            if apart_ is not None:
                ok &= apart_[o] != apart_[me]
            j = np.flatnonzero(ok)
            for x in (folded, full):
                if not len(j):
                    break
                differ = np.bitwise_count(x[i + 1 + j] ^ x[i]).sum(1, dtype=np.int64)
                j = j[(den + num) * differ <= (den - num) * (n[o[j]] + n[me])]
            if len(j):
                yield me, o[j]


def _links(raw: list[bytes], n, ids, c, t, cross: bool, num: int, den: int, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest of links of one group; c, the component of each document, follows them."""
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.split(place.astype(np.int32), np.cumsum(n)[:-1])
    mark = np.zeros(len(values), bool)
    del values
    found = []
    for me, other in near(raw, n, c, t if cross else None, num, den):
        mark[place[me]] = True
        for x in range(0, len(other), 128):
            some = other[x : x + 128]
            some = some[c[some] != c[me]]
            if not len(some):
                continue
            both = np.add.reduceat(mark[np.concatenate([place[k] for k in some])].astype(np.int64), np.cumsum(n[some]) - n[some])
            for k in some[den * both >= num * (n[some] + n[me] - both)]:
                if c[k] != c[me]:
                    found.append((int(ids[me]), int(ids[k])))
                    c[c == c[k]] = c[me]
        mark[place[me]] = False
    return found


def close_tile(num: int, den: int):
    """Two tiles of sketches, or one with itself, to the close pairs of different components."""

    def work(table: pa.Table) -> pa.Table:
        ids, c, t, n = (table[x].to_numpy() for x in ("doc_id", "c", "t", "n"))
        cross = table["x"][0].as_py() != table["y"][0].as_py()
        a, b = [ids[:0]], [ids[:0]]
        for me, other in near(table["bits"].to_pylist(), n, c, t if cross else None, num, den):
            a.append(np.full(len(other), ids[me]))
            b.append(ids[other])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return work


def sketches(width: int):
    """Texts to the size of their set and their sketch; other columns stay."""

    def work(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            texts = V.Texts.of(t["text"])
            for i, j in V.slices(texts, 2 << 20):
                s = Sets(V.part(texts, i, j), width)
                rows = t.slice(i, j - i).select(["key", "doc_id", "c", "core", "nr", "nc"])
                rows = rows.append_column("n", pa.array(s.sizes, pa.int64())).append_column("bits", pa.array([parity(s.of(k)) for k in range(j - i)], pa.binary()))
                yield from rows.to_batches()

    return work


def tiled(rows: DataFrame, n_buckets: int, work, dealings: int = 0) -> DataFrame:
    """work on rows (key, doc_id, c, nt and text), the documents of a key being dealt to nt tiles by a hash, so many times anew.

    With 0 dealings they are dealt once, and every two tiles of a key meet in a task of their own.
    """
    tiles = rows.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(max(1, dealings)))))
    tiles = tiles.withColumn("t", F.pmod(F.xxhash64("doc_id", "s"), F.col("nt")).cast("int"))
    tiles = tiles.withColumn("o", F.col("t") if dealings else F.explode(F.sequence(F.lit(0), F.col("nt") - 1)))
    # groups of one tile share a task by a hash of the key; each tile of a larger one has its own
    bundle = F.when(F.col("nt") == 1, F.pmod(F.xxhash64("key"), F.lit(n_buckets))).otherwise(F.col("key"))
    tiles = tiles.withColumns({"bundle": bundle, "x": F.least("t", "o"), "y": F.greatest("t", "o")}).drop("o", "nt")
    return tiles.groupBy("bundle", "s", "x", "y").applyInArrow(work, "a long, b long")


def tiles_of(count, size, tile: int, tile_bytes: int):
    return F.ceil(F.greatest(count / tile, size / tile_bytes, F.lit(1.0))).cast("int")


def segments(docs: DataFrame, width: int, threshold: tuple[int, int], doc_id: str, text: str, home: str) -> DataFrame:
    """The packed rows of all batches and, by range of keys, of their meeting: sizes, links (copies) and pairs."""
    n_buckets = buckets(docs, text)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = own.mapInArrow(sketch(width, *threshold, n_buckets), "bucket int, kind string, keys binary, a binary, b binary")
    # what a batch knows by itself passes the reducer as it is, under a range of its own
    spread = rows.withColumn("bucket", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("a"), F.lit(n_buckets)).cast("int")).otherwise(F.col("bucket")))

    def settle(table: pa.Table) -> pa.Table:
        return meet(table) if table["bucket"][0].as_py() >= 0 else table.select(["kind", "a", "b"])

    spread.groupBy("bucket").applyInArrow(settle, FOUND).write.partitionBy("kind").parquet(f"{home}/found")
    X.release(docs.sparkSession)
    return docs.sparkSession.read.schema("a binary, b binary, kind string").parquet(f"{home}/found")


def among(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """docs without most of those whose doc_id is not one of the n ids: a bitmap of hashes, 16 bits an id, is broadcast."""
    words = min(MASK_WORDS, max(64, 1 << (n // 4).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(64 * words))
    word, mask = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    held = ids.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask"))
    return docs.join(F.broadcast(held), word == held["word"]).where(F.col("mask").bitwiseAND(mask) != 0).select(docs.columns)


def buckets(docs: DataFrame, text: str) -> int:
    return max(64, X.text_bytes(docs, text) // (8 << 20))


def pick(found: DataFrame, kind: str) -> DataFrame:
    """(a, b) of one kind of packed rows."""
    return found.where(F.col("kind") == kind).select("a", "b").mapInArrow(unpack, "a long, b long")


def linked(docs: DataFrame, found: DataFrame, width: int, threshold: tuple[int, int], doc_id: str, text: str, home: str, tile: int, round_bytes: int | None = None) -> DataFrame:
    """(doc_id, component_id) of every document that is linked to another one."""
    spark = docs.sparkSession
    num, den = threshold
    X.ensure_checkpoint_dir(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col(doc_id).isNotNull())
    n_buckets = buckets(docs, text)
    group = components(pick(found, "pair").distinct()).withColumnRenamed("component_id", "key").checkpoint()
    length = own.select("doc_id", F.octet_length("text").alias("size"))
    sizes = length.join(group, "doc_id").groupBy("key").agg(F.count("*").alias("g"), F.sum("size").alias("size"))
    plan = group.join(sizes.select("key", tiles_of(F.col("g"), F.col("size"), tile, TILE_BYTES).alias("nt"), (F.col("size") / F.col("g")).alias("mean")), "key").checkpoint()
    links, n_found = pick(found, "link"), 0

    def compare(rows: DataFrame, dealings: int) -> None:
        nonlocal links, n_found
        path = f"{home}/links-{n_found}"
        tiled(rows, n_buckets, link_tile(width, num, den), dealings).write.parquet(path)
        X.release(spark)
        links, n_found = links.unionByName(spark.read.schema("a long, b long").parquet(path)), n_found + 1

    # the texts of all groups are written at once, those of large ones apart, and what follows reads them alone
    X.release(spark)
    grouped = among(own, plan, plan.count()).join(plan.select("doc_id", "key", "nt", (F.col("nt") > 1).alias("large")), "doc_id")
    grouped.write.partitionBy("large").parquet(f"{home}/grouped")
    X.release(spark)
    grouped = spark.read.schema(grouped.schema).parquet(f"{home}/grouped").withColumn("c", F.col("doc_id"))
    compare(grouped.where("not large").drop("large"), 1)
    X.remove(spark, f"{home}/grouped/large=false")
    large = plan.where("nt > 1")
    if not large.limit(1).count():
        return components(links).checkpoint()
    compare(grouped.where("large").drop("large"), SWEEPS)
    texts = grouped.where("large").select("doc_id", "text")
    label = components(links).checkpoint()
    rows = large.join(label, "doc_id", "left").select("doc_id", "key", "mean", F.coalesce("component_id", "doc_id").alias("c"))
    sizes = rows.groupBy("key", "c").agg(F.count("*").alias("k"), F.max("mean").alias("mean"))
    of_key = sizes.groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("m"), F.max("mean").alias("mean")).where("m > top.k")
    tiles = lambda k: tiles_of(k, k * F.col("mean"), 2 * tile, SKETCH_TILE_BYTES)
    of_key = of_key.select("key", F.col("top.c").alias("core_c"), tiles(F.col("m") - F.col("top.k")).alias("nr"), tiles(F.col("top.k")).alias("nc"))
    dealt = rows.drop("mean").join(of_key, "key").select("doc_id", "key", "c", (F.col("c") == F.col("core_c")).alias("core"), "nr", "nc")
    drawn = texts.join(dealt, "doc_id").mapInArrow(sketches(width), "key long, doc_id long, c long, core boolean, nr int, nc int, n long, bits binary")
    pmod = lambda k: F.pmod(F.xxhash64("doc_id"), F.col(k)).cast("int")
    drawn = drawn.withColumn("t", F.when(F.col("core"), F.col("nr") + pmod("nc")).otherwise(pmod("nr")))
    drawn.write.parquet(f"{home}/sketches")
    X.release(spark)
    drawn = spark.read.schema(drawn.schema).parquet(f"{home}/sketches")
    # a sketch goes to each tile it meets; rounds of tiles keep the copies that lie on disk at once below the bytes of all texts
    met = F.col("nr") + F.when(F.col("core"), 0).otherwise(F.col("nc"))
    copies = drawn.agg(F.coalesce(F.sum(F.octet_length("bits") * met.cast("long")), F.lit(0))).first()[0]
    rounds = max(1, -(-copies // max(1, X.text_bytes(docs, text) if round_bytes is None else round_bytes)))
    dealt = drawn.withColumn("o", F.explode(F.sequence(F.lit(0), met - 1)))
    dealt = dealt.select("key", "doc_id", "c", "n", "bits", "t", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"))
    for k in range(rounds):
        some = dealt.where(F.pmod(F.xxhash64("key", "x", "y"), F.lit(rounds)) == k)
        some.groupBy("key", "x", "y").applyInArrow(close_tile(num, den), "a long, b long").write.parquet(f"{home}/close/{k}")
        X.release(spark)
    X.remove(spark, f"{home}/sketches")
    close = components(spark.read.schema("a long, b long").parquet(*(f"{home}/close/{k}" for k in range(rounds)))).withColumnRenamed("component_id", "key").checkpoint()
    size = texts.select("doc_id", F.octet_length("text").alias("size")).join(close, "doc_id").groupBy("key").agg(F.count("*").alias("g"), F.sum("size").alias("size"))
    some = close.join(size.select("key", tiles_of(F.col("g"), F.col("size"), tile, TILE_BYTES).alias("nt")), "key").join(label, "doc_id", "left")
    compare(texts.join(some.select("doc_id", "key", F.coalesce("component_id", "doc_id").alias("c"), "nt"), "doc_id"), 0)
    X.remove(spark, f"{home}/grouped")
    return components(links).checkpoint()


def jaccard_components(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text", tile: int = TILE, round_bytes: int | None = None) -> DataFrame:
    """(doc_id, component_id) of every document that is linked to another one."""
    home = X.shared_dir(docs.sparkSession)
    return linked(docs, segments(docs, width, threshold, doc_id, text, home), width, threshold, doc_id, text, home, tile, round_bytes)


def ngram_join(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    home = X.shared_dir(docs.sparkSession)
    found = segments(docs, width, threshold, doc_id, text, home)
    label = linked(docs, found, width, threshold, doc_id, text, home, tile)
    sizes = pick(found, "size").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    return sizes.join(label, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without those linked, directly or not, to an earlier one; of rows equal in doc_id and text one stays.

    Earlier is the smaller doc_id and, between rows that share it, the smaller SHA-256 of the text. Rows without
    a doc_id are compared with no other text.
    """
    own = F.col(doc_id).cast("long")
    if not docs.groupBy(own.alias("i")).count().where("count > 1").limit(1).count():
        label = jaccard_components(docs, width, threshold, doc_id, text)
        gone = label.where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id))
        return docs.join(gone, doc_id, "left_anti")
    # doc_ids repeat: rows are numbered, and the numbers are kept as they are in a file
    path = f"{X.shared_dir(docs.sparkSession)}/rows"
    docs.dropDuplicates([doc_id, text]).withColumn("_row", F.when(own.isNotNull(), F.monotonically_increasing_id())).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    label = jaccard_components(rows, width, threshold, "_row", text).withColumnRenamed("doc_id", "_row")
    at = rows.select("_row", own.alias("i"), F.sha2(F.col(text).cast("binary"), 256).alias("h")).join(label, "_row")
    first = at.groupBy("component_id").agg(F.min(F.struct("i", "h", "_row")).alias("f")).select("f._row")
    return rows.join(at.join(first, "_row", "left_anti").select("_row"), "_row", "left_anti").drop("_row")
