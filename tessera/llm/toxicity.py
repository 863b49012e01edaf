"""Toxicity (operator 9): a convolutional text classifier trained in numpy, applied to whole texts.

Lower-cased words and their first few bytes are hashed to rows of an embedding table; filters of several widths slide over the
words, each filter's largest response in the text is kept, and a logistic layer scores them. Training starts on
labelled rows in the order of a hash of doc_id, at most `max_train` of them and `max_bytes` of their texts (a text that
does not fit any more is passed over), in one task. If there are more labelled rows, all of them teach then: they are dealt by
a hash to shards of about that size, each shard's task goes through its rows, once at least, from the common start, and the
changes are averaged (those of a word's embedding over the shards that saw it). The driver gets the averaged net alone. Every
fifth row of each class (in a shard) only calibrates: one shift and scale maps the best threshold of all calibration rows to 0.7,
and each language gets a threshold of its own for `flagged`; beyond one shard they come from exact counts by 1/128 of a
logit. Language, source, labels and ids never enter a score.

Rules: only rows whose crc32(doc_id as text) mod 3 is not 1 teach. Null and empty texts are scored as a
text without responses; a very long text is scored as a whole. Null labels are dropped; repeated labels, and all rows of a
repeated doc_id, are used; each row is scored by its own text, so equal texts tie. Without both classes among the
teaching rows the score is the rate of toxic ones, 0 for an empty table of labels. Null ids are scored and
count as not held out. An empty table of documents gives no rows. Extra columns are ignored, and kept by `drop_toxic`
whatever their names.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as V
from .exchange import free_name, release, shared_dir

NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
CUT = 0.7
#: Bytes of the word beginnings that are embedded beside the word, so inflected words share their stem.
STEMS = (4, 5, 6)
#: Rate at which the shards go on from the common start, and their least steps; embeddings in a slice of the changes; bins a logit, and the largest one.
LATER_RATE, LATER_STEPS = 0.005, 200
SLICE = 256
BINS, MOST = 128, 16


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_ids(texts: V.Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word and its stems, first word of each text and the end); bucket 0 pads."""
    low = V.Texts(V.LOWER[texts.data], texts.offsets)
    w = V.words(low, NOT_WORD)
    ids = np.zeros((len(w.starts), 1 + len(STEMS)), np.int32)
    for i, n in enumerate((None, *STEMS)):
        ends = w.ends if n is None else np.minimum(w.starts + n, w.ends)
        ids[:, i] = (V.spans_hash(low.data, w.starts, ends) ^ np.uint64(n or 0)) % np.uint64(buckets - 1) + np.uint64(1)
    return ids, w.first


@dataclass
class Net:
    buckets: int = 1 << 15
    dim: int = 16
    filters: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    seed: int = 7
    scale: float = 1.0
    shift: float = 0.0
    rate: float | None = None
    thresholds: dict = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.emb = (rng.standard_normal((self.buckets, self.dim)) * 0.02).astype(np.float32)
        self.emb[0] = 0
        self.conv = [(rng.standard_normal((k, self.dim, self.filters)) * (1.5 / np.sqrt(k * self.dim))).astype(np.float32) for k in self.widths]
        self.bias = [np.zeros(self.filters, np.float32) for _ in self.widths]
        self.out = (rng.standard_normal(self.filters * len(self.widths)) * 0.3).astype(np.float32)
        self.out_bias = np.float32(-1.0)

    def padded(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts apart by the widest filter less one, and never empty."""
        gap = max(self.widths)
        n = np.diff(first)
        start = first[:-1] + np.arange(len(n)) * gap
        out = np.zeros((int(first[-1]) + gap * (len(n) + 1), ids.shape[1]), np.int32)
        out[np.arange(len(ids)) + np.repeat(start - first[:-1], n)] = ids
        return out, start

    def pooled(self, ids: np.ndarray, first: np.ndarray):
        """Largest response of each filter in each text (rectified), with what training needs."""
        seq, start = self.padded(ids, first)
        x = self.emb[seq[:, 0]]
        for c in range(1, seq.shape[1]):
            x += self.emb[seq[:, c]]
        size = len(seq) - max(self.widths) + 1
        every = []
        for w, b in zip(self.conv, self.bias, strict=True):
            y = x[:size] @ w[0]
            for o in range(1, len(w)):
                y += x[o : o + size] @ w[o]
            every.append(np.maximum.reduceat(y, start, axis=0) + b)
        return np.maximum(np.concatenate(every, 1), 0), seq, start, x, size

    def logits(self, ids: np.ndarray, first: np.ndarray, most: int = 200_000) -> np.ndarray:
        """Texts together as long as they have about `most` words."""
        out, i, n = [np.zeros(0)], 0, len(first) - 1
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(first, first[i] + most, side="right")) - 1))
            out.append(self.pooled(ids[first[i] : first[j]], first[i : j + 1] - first[i])[0] @ self.out + self.out_bias)
            i = j
        return np.concatenate(out)

    def fit(self, ids: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.01) -> None:
        rng = np.random.default_rng(self.seed + 1)
        params = [self.emb, *self.conv, *self.bias, self.out]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        weight = np.where(y > 0, min(10.0, (len(y) - y.sum()) / max(1.0, y.sum())), 1.0)
        step, bias_m = 0, [0.0, 0.0]
        while step < steps:
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch)[: steps - step]:
                rows = np.sort(order[i : i + batch])
                n = np.diff(first)[rows]
                f = np.r_[0, np.cumsum(n)]
                part = ids[np.arange(int(f[-1])) + np.repeat(first[rows] - f[:-1], n)]
                h, seq, start, x, size = self.pooled(part, f)
                z = h @ self.out + self.out_bias
                g = (weight[rows] * (1 / (1 + np.exp(-z)) - y[rows]) / len(rows)).astype(np.float32)
                grads = [np.zeros(0)] * len(params)
                grads[-1] = h.T @ g
                dh = (g[:, None] * self.out) * (h > 0)
                touched, values = [], []
                stop = np.r_[start[1:], size]
                for k, w in enumerate(self.conv):
                    d = dh[:, k * self.filters : (k + 1) * self.filters]
                    yk = sum(x[o : o + size] @ w[o] for o in range(len(w)))
                    best = np.stack([start[r] + yk[start[r] : stop[r]].argmax(0) for r in range(len(rows))])
                    gw = np.zeros_like(w)
                    for o in range(len(w)):
                        at = best + o
                        gw[o] = np.einsum("rfd,rf->df", x[at], d)
                        grad = (d[:, :, None] * w[o].T[None]).reshape(-1, self.dim)
                        for c in range(seq.shape[1]):
                            touched.append(seq[at, c].ravel())
                            values.append(grad)
                    grads[1 + k] = gw
                    grads[1 + len(self.conv) + k] = d.sum(0)
                step += 1
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, gr, (m, v) in list(zip(params, grads, moments, strict=True))[1:]:
                    m += 0.1 * (gr - m)
                    v += 0.001 * (gr * gr - v)
                    p -= rate * fix * m / (np.sqrt(v) + 1e-7)
                gb = float(g.sum())
                bias_m[0] += 0.1 * (gb - bias_m[0])
                bias_m[1] += 0.001 * (gb * gb - bias_m[1])
                self.out_bias -= np.float32(rate * fix * bias_m[0] / (np.sqrt(bias_m[1]) + 1e-7))
                t, vals = np.concatenate(touched), np.concatenate(values)
                rows_, back = np.unique(t, return_inverse=True)
                ge = np.zeros((len(rows_), self.dim), np.float32)
                np.add.at(ge, back, vals)
                m, v = moments[0]
                m[rows_] += 0.1 * (ge - m[rows_])
                v[rows_] += 0.001 * (ge * ge - v[rows_])
                self.emb[rows_] -= rate * fix * m[rows_] / (np.sqrt(v[rows_]) + 1e-7)
                self.emb[0] = 0

    def rest(self) -> np.ndarray:
        """All parameters but the embeddings, in one row."""
        return np.concatenate([*(p.ravel() for p in (*self.conv, *self.bias, self.out)), np.float32([self.out_bias])])

    def moved(self, emb: np.ndarray, rest: np.ndarray) -> Net:
        """This net, uncalibrated, with its parameters moved by so much."""
        net, at = Net(self.buckets, self.dim, self.filters, self.widths, self.seed), 0
        net.emb = self.emb + emb
        to = (self.rest() + rest).astype(np.float32)
        for group, old in ((net.conv, self.conv), (net.bias, self.bias)):
            for k, p in enumerate(old):
                group[k], at = to[at : at + p.size].reshape(p.shape), at + p.size
        net.out, net.out_bias = to[at:-1].copy(), to[-1]
        return net

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(first) - 1, self.rate)
        z = self.scale * (self.logits(ids, first).astype(float) - self.shift) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1: midway between the scores on both sides."""
    by = np.argsort(-z, kind="stable")
    z, y = z[by], y[by]
    tp = np.cumsum(y)
    f1 = 2 * tp / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    i = int(np.argmax(f1))
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i] - 1)


def teaching_ids(docs: DataFrame, labels: DataFrame, max_train: int, max_bytes: int, doc_id: str, text: str, label: str) -> tuple[list[int], int]:
    """The ids of the bounded sample, from two numbers of each of at most max_train ids; the shards that all labelled rows fill."""
    known = labels.where(~held_out(doc_id) & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("_id")).distinct()
    sized = docs.select(F.col(doc_id).cast("long").alias("_id"), F.octet_length(text).alias("_n")).join(known, "_id")
    first = sized.groupBy("_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count("*").alias("c")).orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(max_train)
    every = sized.agg(F.count("*").alias("c"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()
    rows, size, kept = 0, 0, []
    for r in first.collect():
        if rows + r.c <= max_train and size + r.n <= max_bytes:
            rows, size = rows + r.c, size + r.n
            kept.append(r[0])
    return kept, 1 if rows == every.c else max(2, -(-every.c // max_train), -(-every.n // max_bytes))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8000, max_bytes: int = 32 << 20, steps: int = 400, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang") -> Net:
    """A net from all labelled rows outside the held-out third."""
    net, spark = Net(), docs.sparkSession
    kept, n_shards = teaching_ids(docs, labels, max_train, max_bytes, doc_id, text, label)
    kept = spark.createDataFrame([(x,) for x in kept], "_id long")
    marks = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).cast("long").alias("_id"), F.col(label).alias("_y"))
    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("t"), (F.col(lang) if lang in docs.columns else F.lit(None)).cast("string").alias("l"))

    def hashed(batches):
        for batch in batches:
            texts = V.Texts.of(batch.column("t"))
            for i, j in V.slices(texts, 1 << 20):
                ids, first = word_ids(V.part(texts, i, j), net.buckets)
                body = [ids[a:b].astype(np.uint16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in ("_id", "l")] + [pa.array(body, pa.binary())], names=["_id", "l", "ids"])

    words = own.join(F.broadcast(kept), "_id").mapInArrow(hashed, "_id long, l string, ids binary")

    def learn(table: pa.Table) -> pa.Table:
        return pa.table({"net": pa.array([pickle.dumps(taught(net, table, steps))], pa.binary())})

    # one task learns from the whole bounded sample; the driver gets the net alone
    found = words.join(marks.join(F.broadcast(kept), "_id"), "_id").groupBy(F.lit("all").alias("_all")).applyInArrow(learn, "net binary").collect()
    if not found and n_shards == 1:
        net.rate = 0.0
    start = pickle.loads(found[0][0]) if found else net
    return start if n_shards == 1 else continued(start, own, marks, n_shards, max_train)


def continued(start: Net, own: DataFrame, marks: DataFrame, n_shards: int, max_train: int) -> Net:
    """The net after each shard of all teaching rows (_id, t, l) with marks (_id, _y) went on from the start."""
    spark, home = own.sparkSession, shared_dir(own.sparkSession)
    own, marks = (x.where(F.col("_id").isNotNull() & ~held_out("_id")) for x in (own, marks))
    # rows of an id that fills shards by itself are dealt by their texts too, and its marks go to each of its parts
    often = own.groupBy("_id").count().where(F.col("count") > max_train).select("_id", F.ceil(F.col("count") / max_train).cast("int").alias("_k"))
    part = F.pmod(F.xxhash64("t"), F.coalesce("_k", F.lit(1))).cast("int")
    shard = F.pmod(F.xxhash64("_id", "_p", F.lit(13)), F.lit(n_shards)).cast("int").alias("shard")
    texts = own.join(F.broadcast(often), "_id", "left").withColumn("_p", part).select(shard, "_id", "_p", "t", "l")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))
    given = marks.join(F.broadcast(often), "_id", "left").withColumn("_p", parts).select(shard, "_id", "_p", F.col("_y").cast("double").alias("_y"))

    def go_on(rows: pa.Table, known: pa.Table) -> pa.Table:
        out = {"kind": [], "slice": [], "shard": [], "l": [], "y": [], "body": []}

        def put(*row):
            for column, x in zip(out.values(), row, strict=True):
                column.append(x)

        table = rows.join(known.drop(["shard"]), ["_id", "_p"], join_type="inner") if len(rows) and len(known) else rows.slice(0, 0)
        if len(table):
            table, number = table.combine_chunks(), table["shard"][0].as_py()
            column, each = V.Texts.of(table["t"]), []
            for i, j in V.slices(column, 1 << 20):
                ids, first = word_ids(V.part(column, i, j), start.buckets)
                each += [ids[a:b].astype(np.uint16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            table = table.select(["_id", "_y", "l"]).append_column("ids", pa.array(each, pa.binary()))
            del column, each
            table = table.sort_by([("_id", "ascending"), ("_y", "ascending"), ("ids", "ascending")])
            y = (table["_y"].to_numpy() > 0).astype(np.float64)
            test = calibrating(y)
            body, langs = table["ids"].to_pylist(), table["l"].to_pylist()
            if (~test).any():
                net = start.moved(np.float32(0), np.float32(0))
                net.fit(*packed([np.frombuffer(body[i], np.uint16).reshape(-1, 1 + len(STEMS)) for i in np.flatnonzero(~test)]), y[~test], steps=max(LATER_STEPS, -(-int((~test).sum()) // 64)), rate=LATER_RATE)
                change = net.emb - start.emb
                for k in range(0, start.buckets, SLICE):
                    put("change", k // SLICE, number, None, None, change[k : k + SLICE].tobytes())
                put("change", -1, number, None, None, (net.rest() - start.rest()).tobytes())
            for i in np.flatnonzero(test):
                put("row", None, number, langs[i], float(y[i]), body[i])
        return pa.table(out, schema=pa.schema([("kind", pa.string()), ("slice", pa.int32()), ("shard", pa.int32()), ("l", pa.string()), ("y", pa.float64()), ("body", pa.binary())]))

    texts.groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(go_on, "kind string, slice int, shard int, l string, y double, body binary").write.partitionBy("kind").parquet(f"{home}/taught")
    release(spark)
    taught_rows = spark.read.schema("slice int, shard int, l string, y double, body binary, kind string").parquet(f"{home}/taught")

    def mean(table: pa.Table) -> pa.Table:
        table, k = table.sort_by("shard"), table["slice"][0].as_py()
        total, seen = 0.0, 0
        for x in table["body"].to_pylist():
            x = np.frombuffer(x, np.float32).astype(float).reshape(-1, start.dim if k >= 0 else 1)
            total, seen = total + x, seen + ((x != 0).any(1, keepdims=True) if k >= 0 else 1)
        return pa.table({"slice": pa.array([k], pa.int32()), "body": pa.array([(total / np.maximum(seen, 1)).astype(np.float32).tobytes()], pa.binary())})

    change = {r[0]: np.frombuffer(r[1], np.float32) for r in taught_rows.where("kind = 'change'").select("slice", "shard", "body").groupBy("slice").applyInArrow(mean, "slice int, body binary").collect()}
    net = start
    if change:
        net = start.moved(np.concatenate([change[k] for k in range(len(change) - 1)]).reshape(start.emb.shape), change[-1])

    def binned(batches):
        for batch in batches:
            each = [np.frombuffer(x, np.uint16).reshape(-1, 1 + len(STEMS)).astype(np.int32) for x in batch.column("body").to_pylist()]
            z = np.clip(net.logits(*packed(each)), -MOST, MOST) if each else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("l").fill_null(""), pa.array(np.floor(z * BINS).astype(np.int32)), batch.column("y")], names=["l", "bin", "y"])

    path = f"{home}/bins"
    taught_rows.where("kind = 'row'").select("l", "y", "body").mapInArrow(binned, "l string, bin int, y double").groupBy("l", "bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).write.parquet(path)
    counts = spark.read.schema("l string, bin int, y double, n long").parquet(path)
    rows = counts.groupBy("bin").agg(F.sum("y"), F.sum("n")).orderBy("bin").collect()
    at, y, n = (np.array([r[i] for r in rows], float) for i in range(3))
    if not 0 < y.sum() < n.sum():
        net.rate = float(y.sum() / max(1, n.sum()))
        return net
    z = (at + 0.5) / BINS
    net.shift = counted_cut(at, y, n)
    net.scale = min(4.0, 4.0 / max(0.5, float(np.sqrt(np.average((z - np.average(z, weights=n)) ** 2, weights=n)))))

    def own_cut(table: pa.Table) -> pa.Table:
        at, y, n = (table.sort_by("bin")[c].to_numpy().astype(float) for c in ("bin", "y", "n"))
        some = y.sum() >= 5 and y.sum() < n.sum()
        return pa.table({"l": pa.array([table["l"][0].as_py()], pa.string()), "cut": pa.array([counted_cut(at, y, n) if some else None], pa.float64())})

    for r in counts.groupBy("l").applyInArrow(own_cut, "l string, cut double").collect():
        net.thresholds[r.l] = CUT if r.cut is None else float(1 / (1 + np.exp(-(net.scale * (r.cut - net.shift) + np.log(CUT / (1 - CUT))))))
    return net


def counted_cut(at: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """best_cut of rising bins with n rows, y of them toxic."""
    at, y, n = at[::-1], y[::-1], n[::-1]
    i = int(np.argmax(2 * np.cumsum(y) / (np.cumsum(n) + max(1, y.sum()))))
    return float((at[i] + at[i + 1] + 1) / 2 / BINS) if i + 1 < len(at) else float(at[i] / BINS - 1)


def calibrating(y: np.ndarray) -> np.ndarray:
    """Every fifth row of each class."""
    test = np.zeros(len(y), bool)
    for c in (0, 1):
        test[np.flatnonzero(y == c)[::5]] = True
    return test


def packed(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]


def taught(net: Net, table: pa.Table, steps: int) -> Net:
    """The net, fitted and calibrated on a table of ids (uint16 of each word and its stems), marks and languages."""
    table = table.sort_by([("_id", "ascending"), ("_y", "ascending"), ("ids", "ascending")])
    y = (table["_y"].to_numpy() > 0).astype(np.float64)
    langs = np.array([x or "" for x in table["l"].to_pylist()])
    each = [np.frombuffer(x, np.uint16).reshape(-1, 1 + len(STEMS)) for x in table["ids"].to_pylist()]
    test = calibrating(y)
    if not (0 < y[~test].sum() < (~test).sum()):
        net.rate = float(y.mean())
        return net
    take = lambda m: (np.concatenate([each[i] for i in np.flatnonzero(m)]), np.r_[0, np.cumsum([len(each[i]) for i in np.flatnonzero(m)])], y[m])
    net.fit(*take(~test), steps=steps)
    a, b, held = take(test)
    z = net.logits(a, b)
    net.shift = best_cut(z, held)
    net.scale = min(4.0, 4.0 / max(0.5, float(np.std(z))))
    s = 1 / (1 + np.exp(-(net.scale * (z - net.shift) + np.log(CUT / (1 - CUT)))))
    langs = langs[test]
    for x in np.unique(langs):
        m = langs == x
        net.thresholds[str(x)] = best_cut(s[m], held[m]) if held[m].sum() >= 5 and held[m].sum() < m.sum() else CUT
    return net


def scored(docs: DataFrame, net: Net, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score as a new column `name`."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text)

    def work(batches):
        for batch in batches:
            texts = V.Texts.of(batch.column(at))
            for i, j in V.slices(texts, 1 << 20):
                s = net.score(*word_ids(V.part(texts, i, j), net.buckets))
                cut = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(s, pa.float64())], names=[*cut.schema.names, name])

    return docs.mapInArrow(work, schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 8000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7), flagged (score >= the language's threshold)."""
    net = train(docs, labels, max_train, doc_id=doc_id, text=text, lang=lang)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    limit = F.lit(CUT)
    for k, v in net.thresholds.items():
        limit = F.when(F.coalesce("lang", F.lit("")) == k, F.lit(v)).otherwise(limit)
    s = scored(own, net)
    return s.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= limit).cast("int").alias("flagged"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = 8000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without those scored 0.7 or more."""
    net = train(docs, labels, max_train, doc_id=doc_id, text=text, lang=lang)
    name = free_name(docs, "score")
    return scored(docs, net, text, name).where(F.col(name) < CUT).drop(name)
