"""Op 11. Conversation prefix trie: double-array tries over prefix shards, shared upper nodes merged globally.

Conversations are rebuilt, equal sequences of turns become one with its count and a digest of its ids, and the distinct sequences are range partitioned in
the order of their turn keys, so a prefix's sequences lie side by side and a frequent prefix spreads over many shards. A shard is a run of about SHARD_TURNS turns. Its turns get
dense ids, its sequences are packed into BASE and CHECK, and a traversal of those arrays gives each node's members; sums over subtrees go from the deepest level up.

Only prefixes of a shard's first and last sequence can occur in another shard. For these upper nodes a shard tells what hangs below them in the shard itself; the parts are added up
by node, and subtrees of upper nodes are ranges in the order of first and last sequences, so their sums are differences of running sums over two rows a shard.

A conversation is one row of turn keys (16 bytes a turn, no text), whose size is that of the longest conversation. Ids of a sequence's members stream through its digest in chunks.
Turn keys are MD5 sums of role and text.

Defined results: turns are ordered by (turn, role, text), ties and repeated rows stay; rows without a conversation id are no conversation; the remainder of a negative id is negative, as in SQL; an empty table has no
conversations and so no node, not even the root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, durable, partitions, table, tune

WORD = r"[^\x20\x09-\x0D]+"
FAMILY, HEAD = 20, 4
SHARD_TURNS = 100_000
CHUNK_IDS = 4096
#: Windows of candidate bases that a node with several children tries before it goes to the end of the arrays.
TRIES, GRID = 16, 1 << 16
NONE = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.md5(b"root").digest()


def originals(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (place, key, words) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    t = t.select("conv_id", place.alias("place"), key.alias("key"), F.regexp_count("text", F.lit(WORD)).alias("words"))
    return t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "key", "words"))).alias("turns"))


def rebuilt(known: DataFrame) -> DataFrame:
    """conv_id, keys, words, seq_key: the first turns of the family's head conversation, then the own ones after as many."""
    head = F.crc32(F.col("conv_id").cast("string")) % HEAD
    kept = F.slice("turns", F.lit(1), F.lit(HEAD - 1))
    heads = known.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), kept.alias("head"))
    r = known.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": head.cast("int")}).join(heads, "base", "left")
    nothing = F.slice("turns", F.lit(1), F.lit(0))
    turns = F.concat(F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    r = r.select("conv_id", turns.alias("turns")).select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words"))
    return r.withColumn("seq_key", F.md5(F.array_join(F.transform("keys", F.hex), "")))


def members(sequences: DataFrame) -> DataFrame:
    """(seq_key, conv_id) -> seq_key, conv_id (the smallest), n, ends_sha256. Equal sequences' ids are chunked by range first, so no task meets them one by one."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, done = None, [], []
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], ["seq_key", "first", "n", "ids"])

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (key != now or len(ids) >= CHUNK_IDS):
                    done.append((now, ids[0], len(ids), ",".join(map(str, ids))))
                    ids = []
                now = key
                ids.append(conv)
            if len(done) >= 1024:
                yield told()
                done = []
        if ids:
            done.append((now, ids[0], len(ids), ",".join(map(str, ids))))
        if done:
            yield told()

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, n, h, done = None, 0, 0, hashlib.sha256(), []

        def told(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string())], ["seq_key", "conv_id", "n", "ends_sha256"])

        for batch in batches:
            for key, start, count, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if key != now:
                    if now is not None:
                        done.append((now, first, n, h.hexdigest()))
                    now, first, n, h = key, start, 0, hashlib.sha256()
                h.update((("," if n else "") + ids).encode())
                n += count
            if len(done) >= 1024:
                yield told(done)
                done = []
        if now is not None:
            yield told([*done, (now, first, n, h.hexdigest())])

    p = partitions(sequences.sparkSession)
    ids = sequences.select("seq_key", "conv_id").repartitionByRange(p, "seq_key", "conv_id").sortWithinPartitions("seq_key", "conv_id")
    parts = ids.mapInArrow(chunks, "seq_key string, first bigint, n bigint, ids string")
    return parts.repartition(p, "seq_key").sortWithinPartitions("seq_key", "first").mapInArrow(streamed, "seq_key string, conv_id bigint, n bigint, ends_sha256 string")


class DoubleArray:
    """A trie of sequences of dense ids: the child of node s by id c is base[s] + c, if check there is s. The root is node 0; bases may be negative."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray):
        """codes of all sequences one after another, sorted so that equal prefixes lie side by side."""
        room = len(codes) + 2
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.check[0] = -2
        self.low, self.end = 1, 1  # no free place before low, no used one from end on
        state = np.zeros(len(start), np.int64)
        for d in range(int(length.max(initial=0))):
            on = np.flatnonzero(length > d)
            s, c = state[on], codes[start[on] + d]
            new = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))
            edge = np.cumsum(new) - 1
            state[on] = self._place(s[new], c[new])[edge]

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, len(self.check) * 3 // 2) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def _free(self, n: int) -> np.ndarray:
        """The first n free places."""
        size = self.low + n
        while True:
            self._grow(size)
            free = self.low + np.flatnonzero(self.check[self.low : size] == -1)
            if len(free) >= n:
                return free[:n]
            size += max(n, 1024)

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places of the edges (parent, code), edges of one parent side by side."""
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        count = np.diff(np.append(first, len(parents)))
        out = np.empty(len(parents), np.int64)
        for f, n in zip(first[count > 1], count[count > 1]):
            out[f : f + n] = self._fit(codes[f : f + n])
            self._take(parents[f : f + n], codes[f : f + n], out[f : f + n])
        single = first[count == 1]
        if len(single):
            out[single] = self._free(len(single))
            self._take(parents[single], codes[single], out[single])
        return out

    def _fit(self, codes: np.ndarray) -> np.ndarray:
        """First fit: places base + codes that are all free."""
        least, wide = int(codes.min()), int(codes.max() - codes.min())
        window = max(1, GRID // len(codes))
        free = self._free(window * TRIES)
        self._grow(max(int(free[-1]), self.end) + wide + 1)
        for k in range(TRIES):
            grid = free[k * window : (k + 1) * window, None] + (codes - least)
            fine = np.flatnonzero((self.check[grid] == -1).all(axis=1))
            if len(fine):
                return grid[fine[0]]
        return self.end + codes - least

    def _take(self, parents: np.ndarray, codes: np.ndarray, places: np.ndarray) -> None:
        self.check[places] = parents
        self.base[parents] = places - codes
        self.end = max(self.end, int(places.max()) + 1)
        while self.low < self.end and self.check[self.low] != -1:
            run = np.flatnonzero(self.check[self.low : self.end] == -1)
            self.low += int(run[0]) if len(run) else self.end - self.low

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children by id; every one must be in the trie."""
        to = self.base[nodes] + codes
        if (self.check[to] != nodes).any():
            raise AssertionError("a sequence left its trie")
        return to


NODES = {
    "key": pa.string(), "parent_key": pa.string(), "low": pa.int64(), "high": pa.int64(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "words": pa.int64(), "ends_sha256": pa.string(),
}
NODES_DDL = "key string, parent_key string, low bigint, high bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string"


def shard_nodes(batch: pa.Table, rank: int) -> pa.RecordBatch:
    """Sorted distinct sequences (conv_id, n, ends_sha256, keys, words) of one shard -> its nodes. Upper ones have a key; their sums leave out themselves and each other."""
    batch = batch.combine_chunks()
    column = lambda name: batch.column(name).chunk(0)
    conv, n = (column(c).to_numpy() for c in ("conv_id", "n"))
    keys = column("keys")
    length = np.diff(keys.offsets.to_numpy())
    start = (keys.offsets.to_numpy() - keys.offsets[0].as_py())[:-1].astype(np.int64)
    flat = keys.flatten()
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    said = column("words").flatten().to_numpy().astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    trie = DoubleArray(codes, start, length)
    size = len(trie.check)
    members, least, words, depth = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
    state = np.zeros(len(conv), np.int64)
    members[0], least[0] = n.sum(), conv.min()
    levels = [np.zeros(1, np.int64)]
    paths = {0: [0], len(conv) - 1: [0]}
    for d in range(int(length.max(initial=0))):
        on = np.flatnonzero(length > d)
        at = start[on] + d
        to = trie.step(state[on], codes[at])
        state[on] = to
        np.add.at(members, to, n[on])
        np.minimum.at(least, to, conv[on])
        words[to], depth[to] = said[at], d + 1
        levels.append(to[np.append(True, to[1:] != to[:-1])])
        for s in paths:
            if length[s] > d:
                paths[s].append(int(state[s]))
    # upper nodes: the key of a prefix, and in which of the shard's two outer sequences it first and last occurs
    upper: dict[int, list] = {}
    for side, (s, path) in enumerate(paths.items()):
        key = ROOT
        for d, node in enumerate(path):
            key = hashlib.md5(key + flat[int(start[s]) + d - 1].as_py()).digest() if d else ROOT
            upper.setdefault(node, [key.hex(), rank + side, rank + side])[2] = rank + side
    shared = np.zeros(size, bool)
    shared[list(upper)] = True
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for level in reversed(levels):
        own = level[~shared[level]]
        leaves[own] += children[own] == 0
        saved[own] += (members[own] - 1) * words[own]
        parent = trie.check[own]
        np.add.at(children, parent, 1)
        np.add.at(leaves, parent, leaves[own])
        np.add.at(saved, parent, saved[own])
    node = np.concatenate(levels)
    ends = dict(zip(state.tolist(), column("ends_sha256").to_pylist()))
    above = np.maximum(trie.check[node], 0)
    under = np.where(node == 0, False, shared[above])
    listed, parents = node.tolist(), above.tolist()
    known = [upper.get(x) for x in listed]
    return pa.RecordBatch.from_arrays([
        pa.array([k and k[0] for k in known], pa.string()), pa.array([upper[p][0] if u else None for p, u in zip(parents, under)], pa.string()),
        pa.array([k and k[1] for k in known], pa.int64()), pa.array([k and k[2] for k in known], pa.int64()), pa.array(least[node]), pa.array(depth[node]),
        pa.array(least[above], pa.int64(), mask=under | (node == 0)), pa.array(members[node]), pa.array(children[node]), pa.array(leaves[node]), pa.array(saved[node]), pa.array(words[node]),
        pa.array([ends.get(x) for x in listed], pa.string()),
    ], list(NODES))


def nodes_by_shard(distinct: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """distinct(conv_id, n, ends_sha256, keys, words) -> NODES of all shards; ranks follow the order of the sequences."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rank, held, turns = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            size = batch.column(3).value_lengths().to_numpy() + 1
            group = (turns + np.cumsum(size)) // shard_turns
            cuts = np.flatnonzero(np.diff(np.append(0, group)))
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a in cuts and held:
                    yield shard_nodes(pa.Table.from_batches(held), rank)
                    rank, held, turns = rank + 2, [], 0
                if b > a:
                    held.append(batch.slice(a, b - a))
                    turns += int(size[a:b].sum())
        if held:
            yield shard_nodes(pa.Table.from_batches(held), rank)

    ordered = distinct.select("conv_id", "n", "ends_sha256", "keys", "words").repartitionByRange(partitions(distinct.sparkSession), "keys").sortWithinPartitions("keys")
    return ordered.mapInArrow(each, NODES_DDL)


def merged_upper(nodes: DataFrame) -> DataFrame:
    """Parts of upper nodes -> key, conv_id, depth, parent_key, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each."""
    add = lambda c: F.sum(c).alias(c)
    whole = nodes.where("key IS NOT NULL").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.first("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"),
        F.min("low").alias("low"), F.max("high").alias("high"), add("n_convs"), add("n_children"), add("n_leaves"), add("saved_tokens"),
    )
    below = whole.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("upper_children"))
    whole = whole.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("upper_children", F.lit(0)))
    whole = durable(whole.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")}))
    sums = whole.groupBy(F.col("low").alias("rank")).agg(add("n_leaves"), add("saved_tokens"))
    ranks = whole.select(F.explode(F.array("low", "high")).alias("rank")).distinct().join(sums, "rank", "left")
    running = Window.orderBy("rank")  # two rows a shard
    upto = ranks.select("rank", *(F.sum(F.coalesce(c, F.lit(0))).over(running).alias(c) for c in ("n_leaves", "saved_tokens")))
    deeper = Window.partitionBy("low").orderBy(F.desc("depth"))
    whole = whole.withColumns({c: F.sum(c).over(deeper) for c in ("n_leaves", "saved_tokens")})
    for end in ("low", "high"):
        whole = whole.join(upto.select(F.col("rank").alias(end), F.col("n_leaves").alias(f"{end}_leaves"), F.col("saved_tokens").alias(f"{end}_saved")), end)
    return whole.select(
        "key", "conv_id", "depth", "parent_key", "n_convs", "n_children", (F.col("n_leaves") + F.col("high_leaves") - F.col("low_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("high_saved") - F.col("low_saved")).alias("saved_tokens"), "ends_sha256",
    )


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one row a node of the trie of rebuilt conversations."""
    known = durable(originals(conversations))
    sequences = durable(rebuilt(known))
    distinct = durable(members(sequences).drop("seq_key").join(sequences.select("conv_id", "keys", "words"), "conv_id"))
    nodes = durable(nodes_by_shard(distinct, shard_turns))
    discard(known, sequences, distinct)
    upper = durable(merged_upper(nodes))
    parent = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("upper_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = nodes.where("key IS NULL").select(*columns, "parent_key").unionByName(upper.select(*(c for c in columns if c != "parent_conv_id"), "parent_key"), allowMissingColumns=True)
    every = every.join(parent, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "upper_conv_id"))
    return every.select(*columns[:-1], F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark, 2048)
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: [ord(CAST(conv_id AS VARCHAR)[i]), -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda crc, op: CASE WHEN op >= 0 THEN xor(crc, op) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295)"""

ORACLE = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
 mixed AS (SELECT c.conv_id, t.i, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h UNION ALL SELECT c.conv_id, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
 r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, role, text FROM mixed),
 p AS (SELECT conv_id, d, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS k, text FROM r UNION ALL SELECT conv_id, 0, 'root', '' FROM c),
 n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS own FROM p GROUP BY k, d),
 par AS (SELECT DISTINCT a.k, b.k AS parent FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d = a.d - 1),
 kids AS (SELECT parent AS k, count(*) AS n FROM par GROUP BY 1),
 sub AS (SELECT a.k, sum(n.own) AS saved, count(*) FILTER (WHERE kids.k IS NULL) AS leaves FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d LEFT JOIN kids ON kids.k = n.k GROUP BY a.k),
 ends AS (SELECT p.k, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN (SELECT conv_id, max(d) AS d FROM p GROUP BY 1) USING (conv_id, d) GROUP BY p.k)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN par ON par.k = n.k LEFT JOIN n q ON q.k = par.parent LEFT JOIN kids ON kids.k = n.k JOIN sub ON sub.k = n.k LEFT JOIN ends ON ends.k = n.k
"""
