"""Operators against SQL, brute force, round trips and held-out accuracy; odd rows in every operator."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import common, hilbert, media, mixing, neardup, packing, pivots, preference, quality, queries, suffix, toxicity
from tests.conftest import oracle, rows

ODD = "doc_id long, text string, lang string, source string, n_chars long, content string"
LONG = " ".join(f"word{k}" for k in range(30_000))
BASE = " ".join(f"tok{k}" for k in range(200))


def odd_rows():
    edited = BASE.replace("tok50 ", "other ")
    texts = [None, "", " \n", "a", "one two three", BASE, BASE, edited, LONG, "x" * 5000, "naïve café ÀÉ 日本語 🙂 " * 40, BASE, "\x00\x01 ctrl"]
    return [(k, t, None if k % 3 == 0 else "en", None if k == 4 else f"s{k % 2}", None, "clash") for k, t in enumerate(texts)] + [(5, BASE, "en", "s1", None, "clash")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def unique(df):
    return df.dropDuplicates(["doc_id"])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(oracle(queries.ORACLES[name], sf_dir))


@pytest.mark.parametrize("name,label,query,least", [("quality", "quality", quality.op1_quality, 0.93), ("toxicity", "toxic", toxicity.op10_toxicity, 0.9)])
def test_held_out_accuracy(spark, name, label, query, least):
    sf = "/root/testdata/sf0.01"
    got = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got[label]).mean() >= least and got.score.between(0, 1).all()


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    never = lambda c: F.lit(False)
    for op, label in ((quality, "quality"), (toxicity, "toxic")):
        w = op.fit(odd, labels, never, label)
        got = {(r.doc_id, r.score) for r in op.score(odd, w).collect()}
        assert {s for _, s in got} == {0.5} and op.score(empty, w).count() == 0
    assert toxicity.reject(odd, np.full(toxicity.SIZE, -1.0)).columns == odd.columns


def test_classifiers_of_one_label(spark, odd):
    never = lambda c: F.lit(False)
    for op, label in ((quality, "quality"), (toxicity, "toxic")):
        for value in (0, 1):
            labels = spark.createDataFrame([(k, value) for k in range(13)] + [(None, 1 - value), (5, None)], f"doc_id long, {label} int")
            scores = [r.score for r in op.score(odd, op.fit(odd, labels, never, label)).collect()]
            assert len(scores) == 14 and all(0 <= x <= 1 for x in scores)
            assert all(x >= 0.5 if value else x <= 0.5 for x in scores)


def plain_ftrl(rows_, epochs, alpha, beta, l1, l2, balance, seed, bias):
    """One row and one feature at a time, in dicts."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    ones = sum(y for _, y in rows_) / len(rows_)
    importance = {1: (0.5 / ones) ** balance, 0: (0.5 / (1 - ones)) ** balance}
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for k in order.permutation(len(rows_)):
            x, y = {**rows_[k][0], bias: 1.0}, rows_[k][1]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = importance[y] * (p - y) * v
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / alpha * w[i]
    return {i: weight(i) for i in z}


def test_quality_weights_equal_plain_ftrl(spark, sf_dir):
    common.tune(spark)
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    fold = lambda c: F.crc32(c.cast("string")) % 3 == 1
    known = docs.join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id").where(~fold(F.col("doc_id")))
    known = known.select("doc_id", "text", "quality", F.pmod(F.xxhash64("doc_id"), F.lit(quality.SHARDS)).alias("shard")).toPandas().sort_values("doc_id")
    total = {}
    for shard, part in known.groupby("shard"):
        batch = pa.RecordBatch.from_pydict({"doc_id": part.doc_id.tolist(), "text": part.text.tolist()})
        rows_ = [(dict(zip(i.tolist(), x.astype(np.float32).tolist())), y) for (_, i, x), y in zip(quality.features(batch), part.quality.tolist())]
        for i, w in plain_ftrl(rows_, 4, 0.5, 1.0, 0.02, 0.01, 0.5, int(shard), quality.SIZE - 1).items():
            total[i] = total.get(i, 0.0) + w / known["shard"].nunique()
    got = quality.fit(docs, labels, fold)
    expected = np.zeros(quality.SIZE)
    expected[list(total)] = list(total.values())
    assert len(known) > 50 and np.allclose(got, expected, atol=1e-6) and np.abs(got).max() > 0.1
    text = "Some words, and SOME more words, words."
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    tokens = re.findall(r"\w+|[^\w\s]+", text)
    low = [t.lower() for t in tokens]
    counts = Counter(low) + Counter(zip(low, low[1:])) + Counter({"shout": 1, "again": sum(t in low[max(k - 2, 0) : k] for k, t in enumerate(low))})
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
    assert np.allclose(sorted(quality.flat(batch)[2]), sorted(math.log1p(c) / norm for c in counts.values()))


def brute_repeats(texts):
    seen = {}
    for b in texts:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        yield gone


@pytest.mark.parametrize("hot", [suffix.HOT, 2])
def test_repeats_equal_brute_force(spark, sf_dir, odd, hot):
    common.tune(spark)
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), unique(odd)):
        got = {r.doc_id: r for r in suffix.remove_repeats(docs, suffix.repeated_spans(docs, hot=hot)).collect()}
        known = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
        for (d, b), gone in zip(known, brute_repeats([b for _, b in known])):
            runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
            assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans) == (len(b), int(gone.sum()), runs)
            assert bytes(got[d].kept) == np.frombuffer(b, np.uint8)[~gone].tobytes()


def test_merged_transforms_equal_sorting():
    rng = np.random.Generator(np.random.PCG64(1))
    strings = rng.integers(97, 99, (40, 12), dtype=np.uint8)
    group = np.sort(rng.integers(0, 5, 40))
    parts = [np.flatnonzero(np.arange(40) % 3 == k) for k in range(3)]
    shards = [suffix.transform(strings[p], group[p]) for p in parts]
    of = np.concatenate(parts)
    for c, who, g, lcp in suffix.merge(shards, [group[p] for p in parts], 12):
        who = of[who]
        keys = [(group[i], strings[i, c:].tobytes()) for i in who]
        assert keys == sorted(keys)
        for (ga, a), (gb, b), n in zip(keys, keys[1:], lcp[1:]):
            assert n == (-1 if ga != gb else next((k for k in range(len(a)) if a[k] != b[k]), len(a)))


def test_empty_repeats(spark, empty):
    assert suffix.remove_repeats(empty, suffix.repeated_spans(empty)).count() == 0


def words(s):
    return re.findall(r"[^\W_]+", s.lower())


def test_near_duplicates_equal_brute_force(spark, sf_dir, odd, empty):
    common.tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    idf = neardup.corpus_idf(docs)
    import pyarrow as pa

    vectors = {}
    for d, t in text.items():
        _, s, w = neardup.weighted(pa.RecordBatch.from_arrays([pa.array([d]), pa.array([t])], ["d", "t"]), 1, idf)
        vectors[d] = dict(zip(s.tolist(), w.tolist()))
    root = {d: d for d in text}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(text, 2):
        va, vb = vectors[a], vectors[b]
        if text[a] == text[b] or (va.keys() & vb.keys() and (m := sum(min(va[k], vb[k]) for k in va.keys() & vb.keys())) / (sum(va.values()) + sum(vb.values()) - m) >= 0.8):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {d: find(d) for d in text}
    of = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(odd).collect()}
    assert {(5, 5), (6, 5), (7, 5), (11, 5), (0, 0), (1, 0)} <= of
    assert neardup.near_duplicates(empty).count() == 0


def crowded(n, shared=600, own=25, edits=5):
    """Texts that share a passage and stay below 0.8, and for every tenth one a near copy."""
    for k in range(n):
        mine = [f"own{k}x{j}" for j in range(own)]
        yield " ".join([*(f"tok{j}" for j in range(shared)), *mine])
        if k % 10 == 0:
            yield " ".join([*(f"tok{j}" if j % (shared // edits) else f"new{k}x{j}" for j in range(shared)), *(w if j != own // 2 else f"new{w}" for j, w in enumerate(mine))])


def chained(n, far):
    """Near copies of each other, and texts that reach 0.8 with one of them only."""
    base = [f"tok{j}" for j in range(300)]
    for k in range(n):
        one = list(base)
        for j in (7 * k % 290, (7 * k + 150) % 290):
            one[j] = f"edit{k}x{j}"
        yield " ".join(one)
        if k < far:
            for j in range(4):
                one[(7 * k + 25 + 60 * j) % 290] = f"far{k}x{j}"
            yield " ".join(one)


def brute_classes(docs):
    import pyarrow as pa

    idf = neardup.corpus_idf(docs)
    known = [(r.doc_id, r.text) for r in docs.collect()]
    vectors = {}
    for d, t in known:
        _, s, w = neardup.weighted(pa.RecordBatch.from_arrays([pa.array([d]), pa.array([t])], ["d", "t"]), 1, idf)
        vectors[d] = (dict(zip(s.tolist(), w.tolist())), w.sum())
    root = {d: d for d in vectors}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(vectors, 2):
        (va, ta), (vb, tb) = vectors[a], vectors[b]
        m = sum(min(va[k], vb[k]) for k in va.keys() & vb.keys())
        if m >= 0.8 * (ta + tb - m):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in root}


@pytest.mark.parametrize("texts", [pytest.param(lambda: crowded(400), id="crowded"), pytest.param(lambda: chained(150, 20), id="chained")])
def test_near_duplicates_of_crowded_buckets(spark, texts):
    common.tune(spark)
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == brute_classes(docs)


def test_hilbert_curve_is_continuous():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    index = hilbert.curve_index([grid[:, k] for k in range(3)], 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, odd, empty, law):
    docs = odd.withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))) + 16)
    got = hilbert.shard(docs, ["size", "doc_id"], ["source", "lang"], ["doc_id", "text"], 4, law).toPandas()
    assert len(got) == 14 and got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    if law == "rows":
        assert got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1
    assert hilbert.shard(empty.withColumn("size", F.lit(16)), ["size"], ["source"], ["doc_id"], 4, law).count() == 0


def test_media_round_trip(spark, odd, empty):
    for payload in (b"\xff" * 576, bytes(range(256)) * 9, b"\x00" * 1152):
        assert media.decode(media.encode(payload)).tobytes() == payload
    got = media.elements('<p>a <b>b</b></p><figure><img src="sha256:d1" alt="z"><figcaption>cap</figcaption></figure><script>x</script><p>c</p><img src="sha256:d2">')
    assert [(e["kind"], e["text"] or e["digest"], e["caption"]) for e in got] == [("text", "a b", None), ("media", "d1", "cap"), ("text", "c", None), ("media", "d2", None)]
    assert media.elements(None) == []
    pages = spark.createDataFrame([(1, '<img src="sha256:zz">'), (2, None)], "page_id int, html string")
    stored = media.store(spark.createDataFrame([("zz", bytearray(b"\x07" * 576))] * 2, "digest string, payload binary"))
    out = {r.page_id: r for r in media.interleaved(pages, "page_id", stored).collect()}
    assert out[1].media[0].feature.startswith("24x24;mean=7") and out[2].elements == []


def test_hot_digest_and_missing_digests(spark):
    """One digest of half of all references, and references without a digest, are split and lose nothing."""
    page = {0: '<img src="sha256:d0" alt="c">', 1: '<img alt="c">'}
    pages = spark.createDataFrame([(i, page.get(i % 4, f'<img src="sha256:d{i}" alt="c">')) for i in range(400)] + [(0, page[0])], "page_id long, html string")
    stored = media.store(spark.createDataFrame([(f"d{i}", bytearray(bytes([i % 256]) * 576)) for i in range(300)], "digest string, payload binary"))
    got = media.resolved(media.parsed(pages, "page_id"), "page_id", media.described(stored)).collect()
    assert len(got) == 401 and sum(r.page_id == 0 for r in got) == 2
    for r in got:
        k = 0 if r.page_id % 4 == 0 else r.page_id
        known = r.page_id % 4 != 1 and k < 300
        assert (r.digest is None) == (r.page_id % 4 == 1) and r.caption == "c"
        assert (r.feature is not None) == known and (not known or r.feature.startswith(f"24x24;mean={k % 256};"))


def write_documents(frame, path):
    frame.write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_op6_equals_brute_force(spark, sf_dir, odd, empty, tmp_path):
    assert media.op6_media(spark, write_documents(empty, tmp_path / "e")).count() == 0
    for path, texts in ((sf_dir, spark.read.parquet(f"{sf_dir}/documents.parquet")), (write_documents(odd, tmp_path / "o"), odd)):
        known = sorted((r.doc_id, (r.text or "").encode()) for r in texts.collect())
        got = sorted(media.op6_media(spark, path).collect(), key=lambda r: (r.doc_id, r.n_bytes, r.payload_sha256))
        assert len(got) == len(known)
        for (d, b), r in zip(known, got):
            p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
            stored = media.encode(p)
            assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
            assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
            assert r.feature == media.feature(np.frombuffer(p, np.uint8).reshape(-1, 24)) and '"kind":"media"' in r.elements


def test_op3_keeps_its_law(spark, odd, empty, tmp_path):
    assert hilbert.op3_hilbert(spark, write_documents(empty, tmp_path / "e")).count() == 0
    got = hilbert.op3_hilbert(spark, write_documents(odd, tmp_path / "o")).toPandas()
    sizes = sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in odd_rows())
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32)) == sizes
    counts = got.groupby("shard").size().reindex(range(40), fill_value=0)
    assert counts.max() - counts.min() <= 1 and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    assert got.groupby("shard").slot.apply(lambda x: sorted(x) == list(range(len(x)))).all()


def brute_top(vectors, query, k):
    return sorted(((-sum(a * b for a, b in zip(vectors[query], v)), i) for i, v in vectors.items() if i != query))[:k]


def test_top_k_of_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (100, [-1.0, 0.5]), (200, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (8, [0.1, -0.3])]
    spark.createDataFrame(v, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in pivots.op5_pivots(spark, str(tmp_path)).collect()}
    whole = {i: [int(np.floor(1024 * x)) for x in e] for i, e in v if i in (0, 1, 2, 100, 8)}
    assert got == {(q, n + 1): (i, -s) for q in (0, 100) for n, (s, i) in enumerate(brute_top(whole, q, 10))}
    (tmp_path / "n").mkdir()
    spark.createDataFrame([], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "n" / "embeddings.parquet"))
    assert pivots.op5_pivots(spark, str(tmp_path / "n")).count() == 0


def test_bounds_eliminate_candidates_of_clustered_vectors():
    rng = np.random.Generator(np.random.PCG64(4))
    centres = rng.normal(0, 2000, (20, 16))
    x = np.floor(centres[np.arange(4000) % 20] + rng.normal(0, 20, (4000, 16))).astype(np.int64)
    distance = lambda a: np.sqrt(((a[:, None].astype(float) - centres[None]) ** 2).sum(2)).astype(np.float32)
    ids, q = np.arange(4000), x[:5]
    floors = np.full(5, -(1 << 62))
    for i, (_, near, score, scored) in enumerate(pivots.search_block(ids[:5], q, distance(q), floors, ids, x, distance(x), 10, False)):
        assert list(zip((-score).tolist(), near.tolist())) == sorted((-int(x[j] @ q[i]), j) for j in range(4000) if j != i)[:10]
        assert scored[0] <= 0.3 * 4000
    big, none = x * (1 << 34), np.zeros((4000, 1), np.float32)  # products beyond what floats hold
    for i, (_, near, score, _) in enumerate(pivots.search_block(ids[:5], q, none[:5], floors, ids, big, none, 10, False)):
        assert list(zip((-score).tolist(), near.tolist())) == sorted((-int(big[j] @ q[i]), j) for j in range(4000) if j != i)[:10]


@pytest.mark.parametrize("kind", ["line", "wide", "far"])
def test_large_vectors_with_their_own_pivots(spark, kind):
    """Scores far beyond what small differences of rounded distances would tell apart."""
    rng = np.random.Generator(np.random.PCG64(9))
    if kind == "line":
        x = np.concatenate([[1000], 100_000_000 + np.arange(2000)])[:, None]
    elif kind == "wide":
        x = rng.integers(-(1 << 27), 1 << 27, (1500, 8))
    else:
        x = np.array([3, -2, 5]) * (1 << 28) + rng.integers(-3, 4, (1500, 3))
    frame = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<long>")
    got = pivots.top_k(frame, lambda c: F.pmod(c, F.lit(100)) == 0, 10).collect()
    for q in range(0, len(x), 100):
        want = sorted((-int(x[j] @ x[q]), j) for j in range(len(x)) if j != q)[:10]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_copies_of_queries_are_not_broadcast(spark, monkeypatch):
    """Many blocks of rows and several groups of queries: the queries' copies, 5 MB in all, are beyond what may be broadcast here; scores tie and repeat."""
    for name, n in (("BLOCK", 32), ("QUERY_BLOCK", 8), ("QUERY_BYTES", 16 * 8 * (512 + 48))):
        monkeypatch.setattr(pivots, name, n, raising=False)
    x = np.random.Generator(np.random.PCG64(6)).integers(-3, 4, (600, 512))
    x[300:400] = x[200:300]
    x[500] = x[400]
    frame = common.durable(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<long>"))
    limit = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "3m")
    try:
        got = pivots.top_k(frame, lambda c: F.pmod(c, F.lit(10)) == 0, 10).collect()
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", limit)
    s = x @ x.T
    want = {(q, n + 1): (j, -t) for q in range(0, 600, 10) for n, (t, j) in enumerate(sorted((-int(s[q, j]), j) for j in range(600) if j != q)[:10])}
    assert len(got) == 600 and {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == want


def test_how_many_embeddings_are_scored(spark):
    """Bounds never score more than all pairs, and first passes score FIRST a block; the count is the operator's own."""
    rows = common.durable(pivots.usable(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))).toPandas()
    x, ids = np.array(rows.v.tolist()), rows.vec_id.to_numpy()
    p = x[:: max(1, len(x) // pivots.PIVOTS)][: pivots.PIVOTS].astype(float)
    d, q = pivots.distances(x.astype(float), p), np.flatnonzero(ids % 100 == 0)
    floors = np.full(len(q), -(1 << 62))
    scored = [s[0] for *_, s in pivots.search_block(ids[q], x[q], d[q], floors, ids, x, d, 10, False)]
    assert len(scored) == len(q) and max(scored) <= len(x)


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    cut = common.durable(packing.pieces(odd, path))
    got = packing.pack(cut).toPandas()
    whole = Tokenizer.from_file(path)
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t, *_ in odd_rows()]
    expected = sorted((d, k, zlib.crc32(i[s : s + 2048].tobytes())) for (d, *_), i in zip(odd_rows(), ids) for k, s in enumerate(range(0, len(i), 2048)))
    assert sorted(zip(got.doc_id, got.piece, got.ids_crc32)) == expected
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset == g.length.cumsum() - g.length).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack(common.durable(packing.pieces(empty, path))).count() == 0


def test_packing_of_quoted_marks(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole = Tokenizer.from_file(path)
    marks = [t.content for t in whole.get_added_tokens_decoder().values()]
    texts = [f"it ends with {m} and goes on" for m in marks] + [m.upper() for m in marks] + ["".join(marks), "é" + marks[0], "<|end of text|>"]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    ids = [np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert got == {k: (len(i), zlib.crc32(i.tobytes())) for k, i in enumerate(ids)}


def test_plan_is_near_the_bound():
    rng = np.random.Generator(np.random.PCG64(3))
    n, c = np.unique(np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1), return_counts=True)
    counts = dict(zip(n.tolist(), c.tolist()))
    plan = packing.plan(counts)
    placed = {}
    for length, _, pieces, *_ in plan:
        placed[length] = placed.get(length, 0) + pieces
    assert placed == counts
    bins = max(first + pieces // each for _, _, pieces, first, each, _ in plan)
    assert bins <= 1.01 * -(-int((n * c).sum()) // 2048) + 1


def test_plan_is_no_worse_than_best_fit_on_real_lengths(sf_dir):
    import bisect

    import pyarrow.parquet as pq

    ids, counts = packing.WordIds(packing.tokenizer_path()), {}
    for batch in pq.ParquetFile(f"{sf_dir}/documents.parquet").iter_batches(256, columns=["text"]):
        for a in ids.texts([s or "" for s in batch.column(0).to_pylist()]):
            for at in range(0, len(a), 2048):
                n = min(2048, len(a) - at)
                counts[n] = counts.get(n, 0) + 1
    for times in (1, 7):
        rooms, bins = [], 0  # plain best-fit decreasing, a piece at a time
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n] * times):
                k = bisect.bisect_left(rooms, n)
                room = rooms.pop(k) if k < len(rooms) else 2048
                bins += room == 2048
                bisect.insort(rooms, room - n)
        plan = packing.plan({n: c * times for n, c in counts.items()})
        assert max(first + pieces // each for _, _, pieces, first, each, _ in plan) <= bins


def test_words_that_the_tokenizer_splits_in_another_way(monkeypatch):
    ids = packing.WordIds(packing.tokenizer_path())
    monkeypatch.setattr(ids, "learn", lambda *_: False)
    texts = ["a plain text", "", "it's another"]
    assert [a.tolist() for a in ids.texts(texts)] == [[*ids.whole.encode(s, add_special_tokens=False).ids, 0] for s in texts]


def test_plan_rows_do_not_follow_the_corpus():
    rng = np.random.Generator(np.random.PCG64(8))
    n, c = np.unique(np.minimum(2048, rng.lognormal(6, 1, 50_000).astype(int) + 1), return_counts=True)
    sizes = [len(packing.plan(dict(zip(n.tolist(), (c * k).tolist())))) for k in (1, 100, 10_000)]
    assert max(sizes) <= 8 * 2048


def test_texts_equal_the_tokenizer():
    import random

    rng, path = random.Random(5), packing.tokenizer_path()
    alphabet = "abcdeSTMDRVLlrevstmd' ' '.,!?0123456789éÀßñÿŸſªº²½­\t\n\r«»İıŁ<|>日я́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["they're we'll I'm he'd it's 'sam ' 's x'tis '", "", "x" * 5000, "'", "a'", "'s", "'ll've"]
    ids = packing.WordIds(path)
    for k in range(0, len(texts), 100):
        for s, got in zip(texts[k : k + 100], ids.texts(texts[k : k + 100])):
            assert got.tolist() == [*ids.whole.encode(s, add_special_tokens=False).ids, 0]


def test_mixing_odd_rows(spark, odd, empty):
    docs = common.durable(mixing.keyed(odd))
    got = mixing.mix(docs, mixing.targets(docs)).toPandas()
    assert len(got) == 14 and got.repeats.between(0, 2).all()
    total = got["size"].sum()
    assert abs(mixing.targets(docs).agg(F.sum("target")).first()[0] - 1.5 * total) < 1e-6 * total
    assert got.groupby(["doc_id", "size"]).repeats.nunique().max() == 1
    unnamed = common.durable(mixing.keyed(odd.withColumn("doc_id", F.lit(None).cast("long"))))
    assert unnamed.select("h").distinct().count() > 5  # rows without an id are told apart by their text
    none = common.durable(mixing.keyed(empty))
    assert mixing.mix(none, mixing.targets(none)).count() == 0


def test_preference_odd_rows(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (2, 0, None, None), (None, 0, "user", "x"), (4, 0, "user", "same"), (5, 0, "user", "same")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in preference.pairs(frame, F.expr("conv_id div 2"), F.pmod("conv_id", F.lit(2)) == 0).collect()}
    assert got[0].prefix_turns == 1 and got[0].prompt == "<|user|>\nq\n<|end|>\n" and got[0].chosen == "<|assistant|>\ngood\n<|end|>\n"
    start, end = got[0].chosen_spans[0]
    assert got[0].chosen[start:end] == "good\n<|end|>"
    assert got[1].rejected is None and got[1].chosen_id == 2 and (got[2].prefix_turns, got[2].chosen, got[2].chosen_spans) == (1, "", [])


def test_preference_of_negative_ids_and_long_texts(spark):
    turns = [(-2, 0, "user", "q"), (-1, 0, "user", "q" * 300_000), (0, 0, "user", "z")]
    spark_rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-")
    spark_rows.write.parquet(f"{folder}/conversations.parquet")
    got = {r.pair_id: (r.chosen_id, r.rejected_id, r.prefix_turns) for r in preference.op8_preference(spark, folder).collect()}
    assert got == {-1: (-2, -1, 0), 0: (0, None, 0)}
    assert preference.pairs(spark_rows.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def test_near_duplicates_of_rows_that_share_an_id(spark):
    common.tune(spark)
    other = " ".join(f"other{k}" for k in range(200))
    rows_ = [(1, BASE), (1, other), (2, BASE.replace("tok50 ", "new ")), (None, other.replace("other7 ", "new ")), (None, "alone here"), (3, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id if r.class_id > 0 else 0) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 3)]


@pytest.mark.parametrize("draws", [400])
def test_samples_meet_as_often_as_texts_are_alike(draws):
    rng = np.random.Generator(np.random.PCG64(6))
    hits = total = 0
    for _ in range(draws // 4):
        s = np.sort(rng.integers(0, 1 << 52, 60, dtype=np.uint64))
        w = rng.uniform(1, 5, 60)
        a, b = slice(0, 50), slice(10, 60)
        _, x = neardup.samples(np.zeros(50, np.int64), s[a], w[a])
        _, y = neardup.samples(np.zeros(50, np.int64), s[b], w[b])
        hits += (x == y).mean()
        total += w[10:50].sum() / w.sum()
    assert abs(hits - total) / (draws // 4) < 0.02


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as c

    text = " ".join(f"own{k}" for k in range(90))
    docs = spark.createDataFrame([(1, text, "en", "s", None, 7, 8, 9), (2, text, "en", "s", None, 7, 8, 9), (3, None, None, None, None, 1, 2, 3)], "doc_id long, text string, lang string, source string, n_chars long, hits int, repeats int, row_key int")
    for stage in (c.drop_near_duplicates, c.cut_repeated_passages, c.mix_sources):
        docs = common.durable(stage(spark, docs, ""))
        assert docs.columns[5:] == ["hits", "repeats", "row_key"]
    assert {(r.doc_id, r.text is None, r.hits) for r in docs.collect()} == {(1, False, 7), (3, True, 1)}


def test_every_stage_on_empty_and_odd_tables(spark, sf_dir):
    import corpus_pipeline as c

    names = ["doc_id", "text", "lang", "source", "n_chars", "label", "score", "toxic", "piece", "length", "rank", "sequence_id", "document"]
    odd_docs = spark.createDataFrame([(*r[:4], None, *range(8)) for r in odd_rows()] + [(None, None, None, None, None, *range(8))] * 2, ", ".join(f"{n} {'string' if n in ('text', 'lang', 'source') else 'long'}" for n in names))
    for name, stage in c.STAGES:
        none = stage(spark, odd_docs.limit(0), sf_dir)
        some = stage(spark, odd_docs, sf_dir)
        assert none.columns == some.columns and none.count() == 0
        if name != "packing":
            assert some.columns == names
        kept = [(r.doc_id, r.text) for r in some.collect()] if name != "packing" else [r.doc_id for r in some.collect()]
        if name == "toxicity":
            assert len(kept) == 16
        elif name == "near_duplicates":  # null and empty texts are alike, so are the texts of BASE
            assert sorted(d for d, _ in kept) == [0, 2, 3, 4, 5, 8, 9, 10, 12]
        elif name == "repeated_passages":
            assert sorted(d for d, _ in kept if d is not None) == sorted(d for d, *_ in odd_rows()) and not any(t for d, t in kept if d in (6, 11))
        elif name == "mixing":
            assert all(kept.count(k) <= 2 * [(d, t) for d, t, *_ in odd_rows()].count(k) for k in kept if k[1] and k[1].strip())
        else:
            assert set(kept) == {None, *range(13)}


def test_pipeline_equals_its_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = common.durable(stage(spark, docs, sf_dir))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before = [(r.doc_id, r.text.encode()) for r in docs.orderBy("doc_id").collect()]
    cut = common.durable(corpus_pipeline.cut_repeated_passages(spark, docs, sf_dir))
    after = {r.doc_id: r.text for r in cut.collect()}
    for (d, b), gone in zip(before, brute_repeats([b for _, b in before])):
        assert after[d] == np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    mixed = corpus_pipeline.mix_sources(spark, cut, sf_dir)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_stages_keep_rows_of_null_and_repeated_ids(spark):
    import corpus_pipeline as c

    passage = " ".join(f"pass{k}" for k in range(60))
    own = lambda k: " ".join(f"only{k}x{j}" for j in range(150))
    texts = [(None, f"{own(0)} {passage}"), (None, f"{own(1)} {passage}"), (7, own(2)), (7, own(2)), (7, own(3)), (None, own(2)), (None, own(4)), (None, own(4)), (8, None), (None, "")]
    docs = common.durable(spark.createDataFrame([(d, t, "en", "s", None) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long"))
    kept = common.durable(c.drop_near_duplicates(spark, docs, ""))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([texts[0], texts[1], texts[2], texts[4], texts[6], texts[8]], key=str)
    assert kept.columns == docs.columns
    cut = common.durable(c.cut_repeated_passages(spark, kept, ""))
    assert cut.columns == docs.columns and cut.count() == 6
    assert all(passage not in (r.text or "") for r in cut.collect())
    assert {(r.doc_id, r.text) for r in c.mix_sources(spark, cut, "").collect()} <= {(r.doc_id, r.text) for r in cut.collect()}
    twice = common.durable(docs.where("text is not null and text <> ''"))
    mixed = [(r.doc_id, r.text) for r in c.mix_sources(spark, twice, "").collect()]
    known = [x for x in texts if x[1]]
    assert set(mixed) == set(known) and all(known.count(x) <= mixed.count(x) <= 2 * known.count(x) for x in known)


def test_repeats_of_null_ids_are_removed(spark, tmp_path):
    passage = " ".join(f"pass{k}" for k in range(60))
    rows = [(None, f"first {passage}"), (None, f"second {passage}"), (3, "third alone"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.op2_suffix(spark, str(tmp_path)).collect())
    n = len(passage) + 1  # and the space before it
    assert got == sorted([(0, 5 + n, n, 1), (0, 6 + n, n, 1), (3, 11, 0, 0), (0, 0, 0, 0)])
