"""Op 2. Repeated passages: shard Burrows-Wheeler transforms merged by iterative interleave refinement.

A byte is repeated if a window of WINDOW bytes that covers it starts anywhere else too.

1. Anchors. Every window holds 169 grams of 32 bytes; the leftmost of the smallest gram hash is its
   anchor, which depends on the window's bytes alone. Equal windows therefore have equal anchors at equal
   offsets, and meet by anchor. All windows of an anchor lie in its snippet, the 368 bytes around it.
2. Pre-aggregation. Equal snippets of an anchor are one row with a count. An anchor that occurs once has nothing
   repeated. Hashes only route: whether a window is repeated is read from merged transforms, copies counted.
3. An anchor's snippets, aligned at the anchor, are dealt to shards, which are built in tasks of their own. A shard
   keeps the Burrows-Wheeler transform of each column: the byte before each suffix, in suffix order. Another
   task merges an anchor's transforms from right to left, without the strings: the interleave of one column, stably
   parted by the transforms' bytes, is the interleave of the column before it. No suffix is sorted again; common prefix
   lengths follow from the range minimum of the column after, and runs of WINDOW or more are the repeated intervals.
4. An anchor with more than HOT distinct snippets (a common passage in varied surroundings) is split by
   ranges of window starts: windows of a range share a core of bytes, whose hash is the new anchor, and the
   narrower snippets collapse again. Ranges shrink to single windows, so any group is split exactly.

Defined results: null and empty texts have no bytes; texts under WINDOW bytes lose nothing; repeated rows
are other places and count as such; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, U64, discard, durable, mix, partitions, passes, row_keyed, table, tune, utf8

WINDOW, GRAM, HOT, SHARDS = 200, 32, 4096, 4
REACH = WINDOW - GRAM  # furthest a window starts before its anchor
SNIPPET = REACH + WINDOW
BATCH_ROWS = 4096
SPLITS = (43, 11, 3, 1)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place (a power of two), by doubling."""
    h, size = BYTE_CODE[raw], 1
    while size < GRAM:
        h = h[: len(h) - size] * U64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    return mix(h)


def leftmost_minima(h: np.ndarray, starts_ok: np.ndarray, width: int) -> np.ndarray:
    """Places that are the leftmost smallest hash of an admitted window of `width` hashes."""
    out, chunk = [], 1 << 22
    for s in range(0, len(starts_ok), chunk):
        ok = starts_ok[s : s + chunk]
        part = h[s : s + len(ok) + width - 1]
        key = (part & U64(0xFFFFFFFFFF000000)) | np.arange(len(part), dtype=U64)
        blocks = -(-len(key) // width) * width
        padded = np.full(blocks, np.iinfo(np.uint64).max, U64)
        padded[: len(key)] = key
        grid = padded.reshape(-1, width)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        at = np.flatnonzero(ok[: len(key) - width + 1])
        low = np.minimum(right[at], left[at + width - 1]) & U64(0xFFFFFF)
        if len(low):
            hit = np.zeros(len(part), bool)
            hit[low.astype(np.int64)] = True
            out.append(np.flatnonzero(hit) + s)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def padded_texts(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with WINDOW zeros before, between and after texts, first byte of each text, lengths)."""
    raw, off = utf8(batch.column(column))
    length = np.diff(off)
    first = off[:-1] + WINDOW * np.arange(1, len(off))
    buf = np.zeros(len(raw) + WINDOW * (len(length) + 1), np.uint8)
    buf[np.arange(len(raw)) + np.repeat(first - off[:-1], length)] = raw
    return buf, first, length


def anchors(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, h (anchor), sid (snippet), pos, step, n: n places pos, pos + step, ... in the document."""

    def find(batches):
        for batch in passes(batches):
            buf, first, length = padded_texts(batch, 1)
            if not (length >= WINDOW).any():
                continue
            h = gram_hashes(buf)
            ok = np.zeros(len(buf) - WINDOW + 1, bool)
            for f, n in zip(first, length):
                if n >= WINDOW:
                    ok[f : f + n - WINDOW + 1] = True
            at = leftmost_minima(h, ok, REACH + 1)
            doc = np.searchsorted(first, at, side="right") - 1
            pos = at - first[doc]
            sid = (np.minimum(pos, REACH) * 1024 + np.minimum(length[doc] - pos, WINDOW)).astype(U64)
            for k in [*range(0, SNIPPET - GRAM + 1, GRAM), SNIPPET - GRAM]:
                sid = mix(sid * U64(_BASE) + h[at - REACH + k])
            key, sid = h[at].view(np.int64), sid.view(np.int64)
            order = np.lexsort((pos, sid, key, doc))
            doc, key, sid, pos = doc[order], key[order], sid[order], pos[order]
            same = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (sid[1:] == sid[:-1])
            gap = np.where(same, np.diff(pos), 0)
            new = np.append(True, ~(same & ((gap == np.append(0, gap[:-1])) | ~np.append(False, same[:-1]))))
            run = np.flatnonzero(new)
            n = np.diff(np.append(run, len(pos)))
            step = np.where(n > 1, np.append(gap, 0)[run], 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc[run])), pa.array(key[run]), pa.array(sid[run]), pa.array(pos[run].astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(n.astype(np.int32))],
                ["doc_id", "h", "sid", "pos", "step", "n"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, h long, sid long, pos int, step int, n int")


def transform(strings: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of aligned strings by column: row c holds the byte before each suffix that starts
    in column c, in suffix order; places of a group stay together, in the order of the strings past the last column."""
    n, width = strings.shape
    bwt = np.zeros((width + 1, n), np.uint8)
    order = np.arange(n)  # strings come by group: past the last column all suffixes of a group are equal
    for c in range(width, 0, -1):
        before = strings[order, c - 1]
        bwt[c] = before
        order = order[np.argsort(group[order].astype(np.int32) * 256 + before, kind="stable")]
    return bwt


def merge(shards: list[np.ndarray], groups: list[np.ndarray], starts: int):
    """Shard transforms and the groups of their places -> for window-start columns starts-1 .. 0: (column, string of each
    merged place (numbered shard by shard, as past the last column), its group, common prefix with the place above)."""
    width = len(shards[0]) - 1
    group = np.concatenate(groups)
    z = np.concatenate([np.full(len(g), k, np.int8) for k, g in enumerate(groups)])
    who = np.argsort(group, kind="stable")
    z, group = z[who], group[who]
    new_group = np.append(True, group[1:] != group[:-1])
    lcp = np.where(new_group, -1, 0).astype(np.int32)
    for c in range(width, -1, -1):
        if c < starts:
            yield c, who, group, lcp
        if not c:
            return
        symbol = np.empty(len(z), np.int32)
        for k, bwt in enumerate(shards):
            symbol[z == k] = bwt[c]
        key = group * 256 + symbol
        step = np.argsort(key, kind="stable")
        key = key[step]
        alike = np.append(False, key[1:] == key[:-1])
        out = np.where(new_group, -1, 0).astype(np.int32)  # groups keep their places
        near = np.flatnonzero(alike)
        if len(near):
            lo, hi = step[near - 1] + 1, step[near] + 1
            bounds = np.column_stack([lo, hi]).ravel()
            low = np.minimum.reduceat(np.append(lcp, 0), bounds)[::2]
            out[near] = low + 1
        z, who, lcp = z[step], who[step], out


def repeated_starts(shards: list[np.ndarray], groups: list[np.ndarray], copies: np.ndarray, low: np.ndarray, high: np.ndarray, starts: int) -> np.ndarray:
    """Bool (string, window start): the group has the same window at that column twice, copies counted.

    Windows of string i start in columns low[i] .. high[i]; strings are numbered shard by shard.
    """
    out = np.zeros((len(low), starts), bool)
    for c, who, _, lcp in merge(shards, groups, starts):
        valid = (low[who] <= c) & (c <= high[who])
        interval = np.cumsum(lcp < WINDOW)
        count = np.bincount(interval, valid * copies[who])
        out[who, c] = valid & (count[interval] >= 2)
    return out


def spans_of(flags: np.ndarray, base: np.ndarray) -> pa.Array:
    """Bytes that flagged windows cover, as lists of ranges lo, hi relative to the anchor (they may overlap)."""
    edge = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    edge = np.diff(edge, axis=1)
    row, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    offsets = np.searchsorted(row, np.arange(len(flags) + 1)).astype(np.int32)
    ranges = pa.StructArray.from_arrays([pa.array((lo + base[row]).astype(np.int32)), pa.array((hi - 1 + WINDOW + base[row]).astype(np.int32))], ["lo", "hi"])
    return pa.ListArray.from_arrays(pa.array(offsets), ranges)


def whole_groups(batches, keys: int):
    """Lists of column lists of about BATCH_ROWS rows that end where the first `keys` columns change."""
    held, count, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        by = np.column_stack([batch.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.flatnonzero((by[1:] != by[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            mine = tuple(by[s].tolist())
            if count >= BATCH_ROWS and mine != last:
                yield pa.Table.from_batches(held)
                held, count = [], 0
            held.append(batch.slice(s, e - s))
            count += e - s
            last = mine
    if held:
        yield pa.Table.from_batches(held)


def binary_rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column."""
    column = column.cast(pa.large_binary()).combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


SHARD = "h long, shard int, place int, sid long, copies long, low int, high int, base int, span int, bwt binary"


def shard_transforms(rows: DataFrame) -> DataFrame:
    """rows(h, sid, copies, bytes, first, base, span) -> one row a string: its shard's transform at its place, all columns.

    An anchor's strings are dealt to SHARDS shards, and shards to tasks of their own; no task sees another's strings.
    """

    def build(batches):
        for t in whole_groups(batches, 2):
            number = lambda name: t[name].to_numpy()
            h, shard, first, base, span = map(number, ("h", "shard", "first", "base", "span"))
            raw, off = binary_rows(t["bytes"])
            length = np.diff(off)
            new = np.append(True, (h[1:] != h[:-1]) | (shard[1:] != shard[:-1]))
            group = np.cumsum(new) - 1
            place = np.arange(len(h)) - np.flatnonzero(new)[group]
            width = int(span.max()) + WINDOW
            low = first - base
            strings = np.zeros((len(h), width), np.uint8)
            row = np.repeat(np.arange(len(h)), length)
            strings[row, np.arange(len(raw)) - np.repeat(off[:-1] - low, length)] = raw
            high = np.minimum(low + length - WINDOW, span)
            own = span + WINDOW + 1  # columns of an anchor's strings; further ones belong to others of the batch
            bwt = transform(strings, group).T[np.arange(width + 1) < own[:, None]]
            cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(h), [None, pa.py_buffer(np.append(0, np.cumsum(own, dtype=np.int64))), pa.py_buffer(bwt)]).cast(pa.binary())
            ints = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), ints(shard), ints(place), pa.array(number("sid")), pa.array(number("copies")), *map(ints, (low, high, base, span)), cells], [x.split()[0] for x in SHARD.split(", ")]
            )

    dealt = rows.withColumn("shard", F.pmod("sid", F.lit(SHARDS)).cast("int")).select("h", "shard", "sid", "copies", "bytes", "first", "base", "span")
    return dealt.repartition(partitions(rows.sparkSession), "h", "shard").sortWithinPartitions("h", "shard", "sid").mapInArrow(build, SHARD)


def merged_groups(rows: DataFrame) -> DataFrame:
    """rows(h, sid, copies, bytes, first, base, span) -> h, sid, ranges: the shards' transforms, merged by anchor, whole groups in bounded batches."""

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        number = lambda name: t[name].to_numpy()
        h, copies = number("h"), number("copies")
        new = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(new) - 1
        keep = np.bincount(group, copies)[group] > 1
        if not keep.any():
            return None
        t, h, copies, group = t.filter(pa.array(keep)), h[keep], copies[keep], group[keep]
        shard, span, base, sid = number("shard"), number("span"), number("base"), number("sid")
        starts = int(span.max()) + 1
        raw, off = binary_rows(t["bwt"])
        bwt = np.zeros((len(h), starts + WINDOW), np.uint8)  # one column more than a string has bytes
        size = np.diff(off)
        bwt[np.repeat(np.arange(len(h)), size), np.arange(len(raw)) - np.repeat(off[:-1], size)] = raw
        rows = [np.flatnonzero(shard == k) for k in range(SHARDS)]
        rows = [r for r in rows if len(r)]
        of = np.concatenate(rows)
        flags = np.empty((len(h), starts), bool)
        flags[of] = repeated_starts([bwt[r].T for r in rows], [group[r].astype(np.int32) for r in rows], copies[of], number("low")[of], number("high")[of], starts)
        hit = flags.any(1)
        return pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array(sid[hit]), spans_of(flags[hit], base[hit])], ["h", "sid", "ranges"])

    def run(batches):
        for t in whole_groups(batches, 1):
            if (out := solve(t)) is not None:
                yield out

    by = shard_transforms(rows).repartition(partitions(rows.sparkSession), "h").sortWithinPartitions("h", "shard", "place")
    return by.mapInArrow(run, "h long, sid long, ranges array<struct<lo:int,hi:int>>")


def split(rows: DataFrame, width: int) -> DataFrame:
    """Rows of crowded groups by narrower ranges of `width` window starts: adds the parents' h and sid; copies stay."""

    def part(batches):
        for batch in batches:
            out = []
            for h, sid, data, first, base, span, copies in zip(*(batch.column(k).to_pylist() for k in range(7))):
                last = min(base + span, first + len(data) - WINDOW)
                for lo in range(base, base + span + 1, width):
                    hi = min(lo + width - 1, base + span)
                    if max(lo, first) > min(hi, last):
                        continue  # none of its windows starts here
                    core = data[hi - first : lo - first + WINDOW]  # every window of the range holds it
                    x = max(lo, first)
                    sub = data[x - first : hi - first + WINDOW]
                    key = hashlib.blake2b(core, digest_size=8, salt=struct.pack("<ii", lo, hi)).digest()
                    mine = hashlib.blake2b(sub, digest_size=8, salt=struct.pack("<i", x)).digest()
                    out.append((int.from_bytes(key, "little", signed=True), int.from_bytes(mine, "little", signed=True), sub, x, lo, hi - lo, h, sid, copies))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), *(pa.array(x, pa.int32()) for x in c[3:6]), *(pa.array(x, pa.int64()) for x in c[6:9])], ["h", "sid", "bytes", "first", "base", "span", "up_h", "up_sid", "copies"])

    return rows.select("h", "sid", "bytes", "first", "base", "span", "copies").mapInArrow(part, "h long, sid long, bytes binary, first int, base int, span int, up_h long, up_sid long, copies long")


def resolve(rows: DataFrame, level: int = 0, hot: int = HOT) -> DataFrame:
    """Distinct snippets by anchor (written) -> h, sid, ranges that are repeated in another snippet of the anchor."""
    crowded = durable(rows.groupBy("h").count().where(F.col("count") > hot).select("h"))
    if level == len(SPLITS) or crowded.isEmpty():
        return merged_groups(rows)
    narrow = durable(split(rows.join(crowded, "h", "left_semi"), SPLITS[level]))
    one = narrow.groupBy("h", "sid").agg(F.first("bytes").alias("bytes"), F.first("first").alias("first"), F.first("base").alias("base"), F.first("span").alias("span"), F.sum("copies").alias("copies"))
    below = resolve(durable(one), level + 1, hot)
    up = narrow.select("h", "sid", "up_h", "up_sid").join(below, ["h", "sid"]).select(F.col("up_h").alias("h"), F.col("up_sid").alias("sid"), "ranges")
    return merged_groups(rows.join(crowded, "h", "left_anti")).union(up)


def snippets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(doc_id, h, sid, pos, copies) -> h, sid, bytes, first, copies, base, span: cut out of the documents."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("h", "sid", "pos", "copies")).alias("wanted"))

    def cut(batches):
        for batch in batches:
            out = []
            for text, want in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.as_buffer().to_pybytes()
                for w in want:
                    a = max(0, w["pos"] - REACH)
                    out.append((w["h"], w["sid"], data[a : w["pos"] + WINDOW], a - w["pos"], w["copies"]))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int64())], ["h", "sid", "bytes", "first", "copies"])

    cut_out = docs.select("doc_id", "text").join(lists, "doc_id").select(F.col("text").cast("binary"), "wanted").mapInArrow(cut, "h long, sid long, bytes binary, first int, copies long")
    return cut_out.withColumns({"base": F.lit(-REACH), "span": F.lit(REACH)})


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text), doc_id unique -> doc_id, hits: places (pos, step, n) with their repeated byte ranges [lo, hi); written."""
    found = durable(anchors(docs))
    often = found.groupBy("h").agg(F.sum("n").alias("places")).where("places > 1").select("h")
    place = durable(found.join(often, "h"))
    discard(found)
    by_sid = place.groupBy("h", "sid").agg(F.sum("n").alias("copies"), F.min(F.struct("doc_id", "pos")).alias("at"))
    pieces = durable(snippets(docs, by_sid.select("h", "sid", "copies", "at.doc_id", "at.pos")))
    marks = durable(resolve(pieces, hot=hot).groupBy("h", "sid").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
    discard(pieces)
    hits = place.join(marks, ["h", "sid"]).select("doc_id", "pos", "step", "n", "ranges")
    hits = durable(hits.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "step", "n", "ranges")).alias("hits")))
    discard(place, marks)
    return hits


def _covered(off: np.ndarray, hits: pa.ListArray) -> np.ndarray:
    """Mask of repeated bytes of a batch of texts that lie one after another at `off`."""
    edge = np.zeros(int(off[-1]) + 1, np.int32)
    per_row = np.diff(hits.offsets.to_numpy()) * hits.is_valid().to_numpy(zero_copy_only=False)
    flat = hits.flatten()  # nulls hold no hits
    row = np.repeat(np.arange(len(per_row)), per_row)
    ranges = flat.field("ranges")
    per_hit = np.diff(ranges.offsets.to_numpy())
    pair = ranges.flatten()
    of = np.repeat(np.arange(len(flat)), per_hit)  # a range's hit
    n = flat.field("n").to_numpy()[of]
    time = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(flat.field("pos").to_numpy()[of].astype(np.int64), n) + time * np.repeat(flat.field("step").to_numpy()[of], n)
    first, last = off[:-1][np.repeat(row[of], n)], off[1:][np.repeat(row[of], n)]
    for field, sign in (("lo", 1), ("hi", -1)):
        place = np.clip(first + at + np.repeat(pair.field(field).to_numpy(), n), first, last)
        edge += sign * np.bincount(place, minlength=len(edge)).astype(np.int32)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """docs(doc_id, text) and repeated_spans -> doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""

    def cut(batches):
        for batch in passes(batches):
            raw, off = utf8(batch.column(1))
            gone = _covered(off, batch.column(2))
            start = gone & ~np.append(False, gone[:-1])
            start[off[:-1][np.diff(off) > 0]] = gone[off[:-1][np.diff(off) > 0]]
            total = lambda x: np.diff(np.append(0, np.cumsum(x))[off])
            n_gone = total(gone)
            kept_off = np.append(0, np.cumsum(np.diff(off) - n_gone))
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(kept_off.astype(np.int64)), pa.py_buffer(raw[~gone])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n_gone), pa.array(total(start)), kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text").join(hits, "doc_id", "left").select("doc_id", "text", "hits")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """docs with `text` cut; all columns and rows stay. A character that loses a byte goes as a whole; null stays null."""
    names, at = docs.columns, docs.columns.index("text")

    def cut(batches):
        for batch in passes(batches, at):
            raw, off = utf8(batch.column(at))
            left = ~_covered(off, batch.column(len(names)))
            known = batch.column(at).is_valid().to_pylist()
            texts = [raw[a:b][left[a:b]].tobytes().decode("utf-8", "ignore") if ok else None for a, b, ok in zip(off, off[1:], known)]
            columns = [pa.array(texts, batch.column(at).type) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.join(hits, "doc_id", "left").select(*(docs[c] for c in names), "hits").mapInArrow(cut, docs.schema)


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    keyed = row_keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))  # ids may be null or repeated
    docs = keyed.select(F.col("row_key").alias("doc_id"), "text")
    out = remove_repeats(docs, repeated_spans(docs)).withColumnRenamed("doc_id", "row_key")
    out = out.select("row_key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return out.join(keyed.select("row_key", "doc_id"), "row_key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
