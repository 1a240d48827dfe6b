"""Op 4. Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Byte-equal texts collapse to one node by a digest (grouped, so a huge group of copies is one row).
2. Shingles of five words weigh tf * idf, with a smoothed idf from the number of documents that hold the shingle,
   over all documents. Shingles in fewer than RARE of the documents share one idf: the table of all others has at most
   (mean distinct shingles a document) / RARE rows, whatever the corpus, so it may be broadcast. It is found in
   two passes: counts by slot of a hash, then exact counts of the shingles in slots that can hold a common one.
3. Consistent weighted samples of the weight vector, in BANDS bands of ROWS; equal bands meet in a bucket. A shingle's
   draws come from its own hash, by the inverse distribution functions.
4. A few rounds link what is near at once: under shared prefix keys (5.) one member a class is compared with a pivot,
   and ever more pivots are tried. They only save comparisons; nothing rests on them.
5. The rest is exact. Every 0.8 pair shares a prefix key: order shingles alike for all texts (by their count among the
   texts in buckets, rarest first) and take those before which the rest still holds 0.8 of the weight. Members of
   different classes that share a key, each with each, are compared unless total weights or the weight left
   from the key on rule the threshold out.
   So every link between two members of buckets is found, whatever the bucket's or the class's size. A text that shares
   no bucket at all is compared with none: a pair of 0.8 meets in no band with a chance of about 0.0002.

Verification is exact weighted Jaccard similarity over whole texts; linked classes become one.

Defined results: texts are compared as lower-cased words (letters and digits); fewer than five words are
one shingle; null and empty texts, and texts without a word, equal only byte-equal ones (null counts as empty); repeated
rows are copies of each other; different texts under one id, or under none, stay different texts, and a class without
any id has a negative number as class_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Tokens, discard, durable, mix, partitions, passes, shingles, table, tune, utf8

WORDS, THRESHOLD, RARE = 5, 0.8, 0.01
BANDS, ROWS = 12, 3
#: Slots of the first count (a power of two), and what floats may lose in a bound.
SLOT_BITS, SLACK = 17, 1e-5
#: Orders of members that keys deal out, by round.
PIVOTS = (8, 64, 512, 4096)


def content(text: Column) -> Column:
    return F.unhex(F.md5(text))


def vectors(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, how often), distinct and ordered by doc and shingle; shingles have 52 bits."""
    t = Tokens(*utf8(batch.column(column), lower=True), punctuation=False)
    s, d = shingles(t.hashes(), t.doc, batch.num_rows, WORDS)
    key = np.sort((d.astype(U64) << U64(52)) | (s >> U64(12)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> U64(52)).astype(np.int64), key & U64((1 << 52) - 1), tf


def slot_of(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> U64(52 - SLOT_BITS)).astype(np.int64)


def common_shingles(docs: DataFrame, least: float) -> DataFrame:
    """docs(doc_id, text) -> shingle, docs: every shingle that `least` documents or more hold, with its exact count."""

    def by_slot(batches):
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in passes(batches):
            n += np.bincount(slot_of(vectors(batch, 1)[1]), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    texts = docs.select("doc_id", "text")
    slots = texts.mapInArrow(by_slot, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(least)).select("slot")
    full = np.zeros(1 << SLOT_BITS, bool)
    full[slots.toArrow()["slot"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(full)

    def exact(batches):
        held = []

        def merged():
            every = np.concatenate([s for s, _ in held])
            order = np.argsort(every)
            every, n = every[order], np.concatenate([n for _, n in held])[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            return every[first], np.add.reduceat(n, first)

        size = 0
        for batch in passes(batches):
            s = vectors(batch, 1)[1]
            s, n = np.unique(s[shared.value[slot_of(s)]], return_counts=True)
            held.append((s, n))
            size += len(s)
            if size > 1 << 21:
                held = [merged()]
                size = len(held[0][0])
        if size:
            s, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "docs"])

    found = texts.mapInArrow(exact, "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))
    return found.where(F.col("docs") >= F.lit(least))


class Idf:
    """Smoothed idf by shingle; shingles that are not in the table are rare."""

    def __init__(self, shingle: np.ndarray, docs: np.ndarray, n: int):
        order = np.argsort(shingle)
        self.shingle = shingle[order]
        self.idf = 1 + np.log((1 + n) / (1 + docs[order]))
        self.rare = 1 + np.log((1 + n) / (1 + RARE * n))

    def of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingle):
            return np.full(len(s), self.rare)
        at = np.minimum(np.searchsorted(self.shingle, s), len(self.shingle) - 1)
        return np.where(self.shingle[at] == s, np.minimum(self.idf[at], self.rare), self.rare)


def corpus_idf(docs: DataFrame) -> Idf:
    n = docs.count()
    common = common_shingles(docs, RARE * n).toArrow()
    return Idf(common["shingle"].to_numpy().view(U64), common["docs"].to_numpy().astype(float), n)


def weighted(batch: pa.RecordBatch, column: int, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, weight), ordered by doc and shingle."""
    d, s, tf = vectors(batch, column)
    return d, s, tf * idf.of(s)


def _gamma_quantiles(bits: int) -> np.ndarray:
    """Gamma(2, 1) at the middles of 2**bits equal shares: its distribution function is 1 - (1 + x) exp(-x)."""
    x = np.concatenate([np.geomspace(1e-4, 1, 1 << 14), np.linspace(1, 40, 1 << 16)[1:]])
    return np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), 1 - (1 + x) * np.exp(-x), x)


_BITS = 14
_R = _gamma_quantiles(_BITS).astype(np.float32)
_C = np.log(_gamma_quantiles(_BITS)).astype(np.float32)
_STEP = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have shingles, their BANDS * ROWS consistent weighted samples as hashes)."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    log_w = np.log(weight).astype(np.float32)
    reps = np.diff(np.append(first, len(doc)))
    out = np.zeros((len(first), BANDS * ROWS), U64)
    for j in range(BANDS * ROWS if len(first) else 0):
        x = shingle * _STEP[j]
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)  # three fields of its bits are the shingle's draws r, c and b
        r = _R[(x >> U64(64 - _BITS)).astype(np.int64)]
        c = _C[((x >> U64(64 - 2 * _BITS)) & U64((1 << _BITS) - 1)).astype(np.int64)]
        b = ((x >> U64(12)) & U64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(log_w / r + b)
        a = c - r * (t - b + 1)
        low = np.minimum.reduceat(a, first)
        here = np.flatnonzero(a == np.repeat(low, reps))
        seg = np.searchsorted(first, here, side="right") - 1
        key = mix(shingle[here] * U64(31) + t[here].astype(np.int64).view(U64))
        best = np.full(len(first), np.iinfo(np.uint64).max, U64)
        np.minimum.at(best, seg, key)  # equal minima: the smallest hash
        out[:, j] = best
    return doc[first], out


def signatures(docs: DataFrame, idf: Idf) -> DataFrame:
    """docs -> doc_id, content (digest of the text), bands (none for texts without a word), total (weight of all shingles)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches):
        for batch in passes(batches):
            d, s, w = weighted(batch, 1, shared.value)
            doc, out = samples(d, s, w)
            band = np.zeros((len(doc), BANDS), U64)
            for k in range(BANDS):
                h = np.full(len(doc), k + 1, U64)
                for j in range(ROWS):
                    h = mix(h * U64(0x9E3779B97F4A7C15) + out[:, k * ROWS + j])
                band[:, k] = h
            has = np.zeros(batch.num_rows, bool)
            has[doc] = True
            offsets = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band.view(np.int64).ravel()))
            total = pa.array(np.bincount(d, w, minlength=batch.num_rows).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists, total], ["doc_id", "content", "bands", "total"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", content(F.col("text"))).mapInArrow(sign, f"doc_id {kind}, content binary, bands array<long>, total double")


def similarity(pairs: DataFrame, idf: Idf) -> DataFrame:
    """pairs(a, b, class_a, class_b, text_a, text_b) -> a, b, class_a, class_b, similarity: exact weighted Jaccard over whole texts."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def compare(batches):
        for batch in passes(batches, 4):
            idf = shared.value
            da, sa, wa = weighted(batch, 4, idf)
            db, sb, wb = weighted(batch, 5, idf)
            key = np.concatenate([(da.astype(U64) << U64(52)) | sa, (db.astype(U64) << U64(52)) | sb])
            w = np.concatenate([wa, wb])
            order = np.argsort(key, kind="stable")
            key, w = key[order], w[order]
            both = np.flatnonzero(key[1:] == key[:-1])
            shared_w = np.bincount((key[both] >> U64(52)).astype(np.int64), np.minimum(w[both], w[both + 1]), minlength=batch.num_rows)
            total = np.bincount(da, wa, minlength=batch.num_rows) + np.bincount(db, wb, minlength=batch.num_rows)
            sim = shared_w / np.maximum(total - shared_w, 1e-12)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sim)], ["a", "b", "class_a", "class_b", "similarity"])

    return pairs.select("a", "b", "class_a", "class_b", "text_a", "text_b").mapInArrow(compare, "a long, b long, class_a long, class_b long, similarity double")


def prefix_keys(texts: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """texts(node, text) -> node, key, total, rest (weight from the key on): two texts that reach the threshold share a key.

    Shingles are ordered by the number of these texts that hold them, rarest first, counted by a shuffle of hashes;
    what one text alone holds can't be shared and gives no row. Written.
    """
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def spread(batches):
        for batch in passes(batches):
            d, s, w = weighted(batch, 1, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(s.view(np.int64)), pa.array(w.astype(np.float32))], ["node", "key", "w"])

    held = durable(texts.select("node", "text").mapInArrow(spread, "node long, key long, w float"))
    counts = held.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1")
    up_to = Window.partitionBy("node").orderBy(F.coalesce("texts", F.lit(1)), "key").rowsBetween(Window.unboundedPreceding, -1)
    w = F.col("w").cast("double")
    placed = held.join(counts, "key", "left").select("node", "key", "texts", w.alias("w"), F.coalesce(F.sum(w).over(up_to), F.lit(0.0)).alias("before"), F.sum(w).over(Window.partitionBy("node")).alias("total"))
    rest = F.col("total") - F.col("before")
    keys = placed.where((rest >= F.col("total") * (threshold - SLACK)) & F.col("texts").isNotNull())
    keys = durable(keys.select("node", "key", F.col("total").cast("float").alias("total"), rest.cast("float").alias("rest")))
    discard(held)
    return keys


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, class: the smallest node of its component. Label passing with pointer jumps, in Spark."""
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("class"))
    labels = durable(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        step = labels.join(near, "node").select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        jump = step.select(F.col("node").alias("class"), F.col("class").alias("root"))
        done = durable(step.join(jump, "class").select("node", "old", F.col("root").alias("class")))
        labels = done.select("node", "class")
        if done.where(F.col("old") != F.col("class")).isEmpty():
            return labels


def rejoined(classes: DataFrame | None, merged: DataFrame) -> DataFrame:
    """classes(node, class) after their classes were merged by merged(node, class)."""
    if classes is None:
        return merged
    step = merged.select(F.col("node").alias("class"), F.col("class").alias("root"))
    moved = classes.join(step, "class", "left").select("node", F.coalesce("root", "class").alias("class"))
    return durable(moved.union(merged.join(classes.select("node"), "node", "left_anti").select("node", "class")))


def star(keys: DataFrame, pivots: int) -> DataFrame:
    """Pairs of one member a class with a key's pivot. Keys deal out `pivots` orders of the members, so that keys of the
    same members meet different pivots; partial aggregation, so a large class is one row a task."""
    order = F.xxhash64("node", F.pmod("key", F.lit(pivots)), F.lit(pivots))
    one = keys.groupBy("key", "class").agg(F.min(F.struct(order.alias("o"), "node", "total")).alias("m")).select("key", "class", "m.*")
    pivot = one.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("o", "node", "class", "total")).alias("pivot")).where("size > 1")
    met = one.join(pivot, "key").where((F.col("node") != F.col("pivot.node")) & close(F.col("total"), F.col("pivot.total")))
    return met.select(F.struct("node", "class").alias("me"), F.struct("pivot.node", "pivot.class").alias("other"))


def close(x: Column, y: Column, threshold: float = THRESHOLD) -> Column:
    """Weighted Jaccard similarity is at most the quotient of the totals: pairs below it need no comparison, and no link is lost."""
    return F.least(x, y) >= F.greatest(x, y) * (threshold - SLACK)


def each_with_each(keys: DataFrame, threshold: float) -> DataFrame:
    """All pairs of members of different classes that share a key and may reach the threshold."""
    kinds = keys.select("key", "class").distinct()
    mixed = durable(keys.join(kinds.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi"))
    # the bounds of a pair, first with a class's widest values, then with one member's, then with both members'
    kinds = mixed.groupBy("key", "class").agg(F.min("total").alias("lo"), F.max("total").alias("hi"), F.max("rest").alias("rest"))
    kind = lambda c: kinds.select("key", F.col("class").alias(f"class_{c}"), F.struct("lo", "hi", "rest").alias(f"kind_{c}"))
    side = lambda c: mixed.select("key", F.col("class").alias(f"class_{c}"), F.struct("node", "class", F.col("total").alias("lo"), F.col("total").alias("hi"), "rest").alias(c))

    def may(x: Column, y: Column) -> Column:
        near = (x["hi"] >= y["lo"] * (threshold - SLACK)) & (y["hi"] >= x["lo"] * (threshold - SLACK))
        # a pair has all it shares from its first common key on, and shares threshold / (1 + threshold) of both totals at least
        return near & (F.least(x["rest"], y["rest"]) >= (x["lo"] + y["lo"]) * (threshold / (1 + threshold) - SLACK))

    x, y = kind("a").alias("x"), kind("b").alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("class_a") < F.col("class_b")) & may(F.col("kind_a"), F.col("kind_b"))).select("x.key", "class_a", "class_b", "kind_b")
    met, one = met.alias("m"), side("a").alias("s")
    met = met.join(one, (F.col("m.key") == F.col("s.key")) & (F.col("m.class_a") == F.col("s.class_a")) & may(F.col("a"), F.col("kind_b"))).select("m.key", "class_b", "a")
    met, one = met.alias("m"), side("b").alias("s")
    both = met.join(one, (F.col("m.key") == F.col("s.key")) & (F.col("m.class_b") == F.col("s.class_b")) & may(F.col("a"), F.col("b")))
    return both.select(F.struct("a.node", "a.class").alias("me"), F.struct("b.node", "b.class").alias("other"))


def classed(df: DataFrame, classes: DataFrame | None) -> DataFrame:
    """df with the class of each node; a node that is in no class yet is its own."""
    if classes is None:
        return df.withColumn("class", F.col("node"))
    return df.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, class_id (smallest doc_id of the class), representative (of byte-equal texts)."""
    idf = corpus_idf(docs)
    signed = durable(signatures(docs, idf))
    distinct = signed.groupBy("content").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("total").alias("total"))
    distinct = durable(distinct.withColumn("node", F.monotonically_increasing_id()))  # written, so that every read finds the same nodes
    rows = distinct.select("node", F.explode("bands").alias("bucket"))
    many = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = rows.join(many, "bucket").select("node").distinct()
    wanted = distinct.join(members, "node").select("node", "content", F.col("rep").alias("doc_id"))
    held = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", content(F.col("text")))
    found = held.join(wanted, (F.col("digest") == F.col("content")) & F.col("id").eqNullSafe(F.col("doc_id")))
    texts = durable(found.groupBy("node").agg(F.first("text").alias("text")))
    keys = prefix_keys(texts, idf, threshold)
    classes = seen = None  # node, class; pairs compared so far
    tried = []

    def link(met: DataFrame) -> bool:
        """Compares the pairs that were not compared before, and merges the classes of those that reach the threshold."""
        nonlocal classes, seen
        low, high = F.least("me", "other"), F.greatest("me", "other")
        pairs = met.select(low.alias("low"), high.alias("high")).select(F.col("low.node").alias("a"), F.col("high.node").alias("b"), F.col("low.class").alias("class_a"), F.col("high.class").alias("class_b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
        checked = durable(similarity(pairs.join(text("a"), "a").join(text("b"), "b").repartition(partitions(docs.sparkSession)), idf))
        tried.append(checked)
        seen = checked.select("a", "b") if seen is None else seen.union(checked.select("a", "b"))
        links = checked.where(F.col("similarity") >= threshold).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
        if links.isEmpty():
            return False
        classes = rejoined(classes, components(links))
        return True

    for pivots in PIVOTS:
        if not link(star(classed(keys, classes), pivots)):
            break
    link(each_with_each(classed(keys, classes), threshold))
    discard(texts, keys, *tried)
    of = classed(distinct.select("content", "rep", "node"), classes)
    own = (F.lit(-1) - F.col("class")).cast(docs.schema["doc_id"].dataType)
    ids = of.groupBy("class").agg(F.min("rep").alias("least")).select("class", F.coalesce("least", own).alias("class_id"))
    return signed.select("doc_id", "content").join(of.join(ids, "class"), "content").select("doc_id", "class_id", F.coalesce("rep", "class_id").alias("representative"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))
