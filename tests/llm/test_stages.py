"""Stages of the pipeline against brute force, and rows that share a doc_id."""

import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
D = "/root/testdata/sf0.001"


def words(n, start):
    return " ".join(f"w{start + i}" for i in range(n))


def test_near_dedup_decides_by_row(spark):
    from tessera.llm.ngram_join import near_dedup

    a, b, c, d, e = (words(30, k * 100) for k in range(5))
    near = e + " more"
    rows = [(1, a), (2, b), (2, b), (3, c), (3, a), (4, near), (4, e), (None, d), (None, d), (None, a), (6, None), (6, None), (7, c)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    from hashlib import sha256

    first = min((e, near), key=lambda x: sha256(x.encode()).hexdigest())
    want = [(1, a, "x"), (2, b, "x"), (3, c, "x"), (4, first, "x"), (None, d, "x"), (None, a, "x"), (6, None, "x")]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)


def near_duplicates_kept(rows):
    """Brute force: ids of (id, text) that no earlier one is linked to, directly or not."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        sets[i] = {hash(tuple(w[j : j + 5])) for j in range(len(w) - 4)} or ({hash(tuple(w))} if w else set())
    root, ids = {i: i for i in sets}, sorted(i for i in sets if sets[i])
    links = [(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :] if 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y])]
    while any(root[x] != root[y] for x, y in links):
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    assert links
    return sorted(i for i in root if root[i] == i)


def windows(text, n):
    w = SPLIT.findall((text or "").translate(FOLD))
    return [tuple(w[j : j + n]) for j in range(len(w) - n + 1)] if n else []


def clean_of(rows, bench):
    """Brute force: ids of (id, text) without a full window of an item, and with no more than one shorter item."""
    items = {}
    for i, text in bench:
        for g in windows(text, min(8, len(SPLIT.findall((text or "").translate(FOLD))))):
            items.setdefault(g, set()).add(i)
    sizes = {len(g) for g in items}
    kept = []
    for k, text in rows:
        hit = [(n, i) for n in sizes for g in windows(text, n) for i in items.get(g, ())]
        if not (any(n == 8 for n, _ in hit) or len({i for _, i in hit}) > 1):
            kept.append(k)
    return sorted(kept)


def test_each_stage_of_a_run_is_what_brute_force_makes_of_the_one_before(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from tessera.llm.toxicity import toxicity

    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, D)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{D}/{x}.parquet") for x in ("labels", "benchmark"))
    assert out.columns == [*docs.columns, "shard"]
    at = {n: spark.read.parquet(f"{tmp_path}/{n}") for n, _ in corpus_pipeline.STAGES}
    assert all(at[n].columns == docs.columns for n in list(at)[:-1])
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    whole = dict(pairs(docs))
    assert all(whole[i] == t for df in at.values() for i, t in pairs(df))
    ids = {n: sorted(i for i, _ in pairs(df)) for n, df in at.items()}
    assert ids["toxicity"] == sorted(r.doc_id for r in toxicity(docs, labels).where("predicted = 0").collect())
    assert ids["ngram_join"] == near_duplicates_kept(pairs(at["toxicity"]))
    assert ids["decontamination"] == clean_of(pairs(at["ngram_join"]), [(r.item_id, r.text) for r in bench.collect()])
    # mixing: weights 3, 1, 2 in the order of the sources, 1.5 times the words, at most twice a source or a document
    rows = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in at["decontamination"].collect()}
    size, got = {}, {}
    for s, n in rows.values():
        size[s] = size.get(s, 0) + n
    for i in ids["mixing"]:
        got[rows[i][0]] = got.get(rows[i][0], 0) + rows[i][1]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size))}
    want, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        want = {s: 2 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in size if x not in capped) for s in size}
        over = {s for s in size if want[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    longest = {s: max(n for x, n in rows.values() if x == s) for s in size}
    assert all(abs(got.get(s, 0) - want[s]) <= longest[s] for s in size)
    assert max(ids["mixing"].count(i) for i in set(ids["mixing"])) <= 2
    # sharding: every row, equal texts together unless larger than a shard, sizes as even as the longest text allows
    assert ids["sharding"] == ids["mixing"]
    shards, by = {}, {}
    for r in out.collect():
        n = len((r.text or "").encode()) + 16
        shards[r.shard] = shards.get(r.shard, 0) + n
        by.setdefault(r.text, []).append((r.shard, n))
    fair = sum(shards.values()) / 40
    assert all(len({s for s, _ in x}) == 1 for x in by.values() if sum(n for _, n in x) <= fair)
    assert max(shards.values()) <= fair + max(n for x in by.values() for _, n in x)


def test_run_takes_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _id int, score double, _h string, shard string"
    long = words(3000, 0)
    extra = (5, 1, 0.5, "h", "x")
    rows = [(1, None, None, None, *extra), (2, "", "en", "a", *extra), (3, long, "en", "a", *extra), (3, words(30, 5000), None, "b", *extra), (3, words(30, 5000), None, "b", *extra), (None, words(40, 9000), "de", None, *extra), (7, long + " end", "en", "a", *extra)]
    labels, items = spark.createDataFrame([(1, 0)], "doc_id long, toxic int"), spark.createDataFrame([(1, words(9, 9010))], "item_id long, text string")
    for name, docs in (("odd", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        items.write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.columns == [*[c for c in spark.read.parquet(f"{d}/documents.parquet").columns if c != "shard"], "shard"]
        kept = {(r.doc_id, r.text) for r in out.collect()}
        assert kept <= ({(3, long), (3, words(30, 5000))} if docs else set())
    d = str(tmp_path / "bare")
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    labels.limit(0).write.parquet(f"{d}/labels.parquet")
    items.limit(0).write.parquet(f"{d}/benchmark.parquet")
    left = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, left, d)
    assert sorted(map(repr, (r.doc_id for r in left.collect()))) == sorted(map(repr, [1, 2, 3, 3, None]))


def test_a_lone_short_item_removes_no_document_in_the_stage(spark, tmp_path):
    from corpus_pipeline import _decontamination

    long = words(9, 0)
    spark.createDataFrame([(1, "yes"), (2, "new york"), (3, long)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "Yes, it is"), (2, "in New York"), (3, "yes, in new york"), (4, f"so {long} on"), (5, "nothing"), (6, "yes yes yes")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in _decontamination(spark, docs, str(tmp_path)).collect()) == [1, 2, 5, 6]
