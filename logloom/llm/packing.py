"""Op 7. Best-fit packing by linear grouping.

Texts become token ids with an end id; longer ones are cut into pieces of the capacity. Piece lengths
are counted (at most `capacity` rows), and the plan is made on those counts alone, so its cost does not
follow the corpus: large lengths are sorted, cut into groups of equal cardinality and rounded up to
the largest of their group; a linear programme over configurations of these few sizes is solved by
column generation; its whole part is filled with actual pieces again, what is left and the small
pieces go where they fit best. Configurations whose actual pieces leave much room are taken apart
and filled with the rest where that saves bins. Pieces find their place from their rank among equal lengths.

Defined results: null and empty texts are one piece of the end id alone; repeated rows are packed each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import POWERS, U64, durable, env_path, mix, passes, table, tune
from .hilbert import ranked

CAPACITY, END, GROUPS = 2048, 0, 40
#: Characters below this are looked up in tables; a text with others, with the content of an added token or with a word of WORD characters or more goes through the tokenizer whole.
LATIN, WORD, CACHED_WORDS = 0x180, 4096, 1_000_000
PLAIN = regex.compile("[\\t\\n\\r -~¡-ſ]")
APOSTROPHE = 39


def tokenizer_path() -> str:
    import public_tokenizers

    return env_path("LOGLOOM_TOKENIZER", public_tokenizers.path("word_bpe_49k.json"))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By character: its small letter, its kind (0 space, 1 letter, 2 number, 3 other), whether the tables hold for it."""
    chars = [chr(c) for c in range(LATIN)]
    kind = [0 if c.isspace() else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3 for c in chars]
    lower = [ord(c.lower()) if len(c.lower()) == 1 else LATIN for c in chars]
    known = [bool(PLAIN.match(c)) and low < LATIN for c, low in zip(chars, lower)]
    return np.array([*lower, LATIN], np.uint16), np.array([*kind, 3], np.uint8), np.array([*known, False])


class WordIds:
    """Token ids of texts. Words are split and hashed for a whole batch at once; each distinct word meets the tokenizer once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.marks = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values() if t.content]
        self.lower, self.kind, self.plain = _tables()
        self.code = mix(np.arange(1, LATIN + 2, dtype=U64)) | U64(1)
        self.reset()

    def reset(self) -> None:
        self.known, self.first, self.count, self.pool = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, c: np.ndarray, start: np.ndarray, length: np.ndarray) -> bool:
        """Adds words of c (hashes ascending): one call of the tokenizer, which splits at the spaces between them.

        False, and nothing added, where the tokenizer finds other words."""
        base = np.cumsum(length + 1) - length - 1
        spelt = np.full(int((length + 1).sum()), ord(" "), "<u4")
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        spelt[place + np.repeat(base, length)] = c[place + np.repeat(start, length)]
        found = self.whole.encode(spelt.tobytes().decode("utf-32-le"), add_special_tokens=False)
        count = np.bincount(np.array(found.word_ids, np.int64), minlength=len(start))
        if len(count) != len(start) or not count.all():
            return False
        first = len(self.pool) + np.cumsum(count) - count
        at = np.searchsorted(self.known, hashes)
        self.known, self.first, self.count = np.insert(self.known, at, hashes), np.insert(self.first, at, first), np.insert(self.count, at, count)
        self.pool = np.append(self.pool, np.array(found.ids, np.uint32))
        return True

    def one(self, text: str) -> np.ndarray:
        return np.array([*self.whole.encode(text, add_special_tokens=False).ids, END], "<u4")

    def new(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        return np.append(self.known, U64(0))[at] != hashes

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with END last."""
        marked = [any(m in s or m in s.lower() for m in self.marks) for s in texts]
        size = np.array([len(s) for s in texts], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        c = np.minimum(np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), LATIN).astype(np.uint16)
        c = self.lower[c]
        kind = self.kind[c]
        before = np.append(np.uint8(0), kind[:-1])
        cut = (kind != before) | (kind == 2)
        # an apostrophe alone before a letter: the contractions 's 't 'm 'd and 're 've 'll are words of their own
        at = np.flatnonzero((c == APOSTROPHE) & (before != 3))
        at = at[kind[at + 1] == 1]  # the last character is a line end
        one, two = c[at + 1], c[np.minimum(at + 2, len(c) - 1)]
        r, v, e, l = map(ord, "rvel")
        short = np.isin(one, [*map(ord, "stmd")])
        long_ = ((one == r) | (one == v)) & (two == e) | (one == l) & (two == l)
        at, step = at[short | long_], np.where(short, 2, 3)[short | long_]
        cut[at + 1] = False
        cut[at + step] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(c)))
        keep = kind[start] > 0
        start, length = start[keep], length[keep]
        doc = np.searchsorted(begin, start, side="right") - 1
        slow = np.array(marked) | (np.add.reduceat(~self.plain[c], begin) > 0)
        slow[doc[length >= WORD]] = True
        fast = ~slow[doc]
        start, length, doc = start[fast], length[fast], doc[fast]
        word = np.zeros(0, np.int64)
        if len(start):
            base = np.cumsum(length) - length
            place = np.arange(int(length.sum())) - np.repeat(base, length)
            h = mix(np.add.reduceat(self.code[c[place + np.repeat(start, length)]] * POWERS[place], base) + length.astype(U64))
            distinct, one, word = np.unique(h, return_index=True, return_inverse=True)
            new = self.new(distinct)
            if len(self.known) + int(new.sum()) > CACHED_WORDS:
                self.reset()
                new[:] = True
            if new.any() and not self.learn(distinct[new], c, start[one[new]], length[one[new]]):
                return [self.one(s) for s in texts]
            word = np.searchsorted(self.known, distinct)[word]
        n, first = self.count[word], self.first[word]
        per_doc = np.bincount(doc, n, minlength=len(texts)).astype(np.int64)
        ids = np.full(int(n.sum()) + len(texts), END, "<u4")
        of = np.repeat(np.cumsum(n) - n, n)
        place = np.arange(len(of))
        ids[place + np.repeat(doc, n)] = self.pool[place - of + np.repeat(first, n)]
        end = np.cumsum(per_doc + 1)
        return [self.one(s) if slow[k] else ids[end[k] - per_doc[k] - 1 : end[k]] for k, s in enumerate(texts)]


_loaded: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        ids_of = _loaded.setdefault(path, None) or _loaded.__setitem__(path, WordIds(path)) or _loaded[path]
        for batch in passes(batches):
            rows = []
            for d, ids in zip(batch.column(0).to_pylist(), ids_of.texts([s or "" for s in batch.column(1).to_pylist()])):
                rows += [(d, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity])) for k, at in enumerate(range(0, len(ids), capacity))]
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], batch.column(0).type), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole part of the configuration programme: (pieces of each size in a bin, bins)."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = np.flatnonzero(sizes <= c)
            v = value[c - sizes[fits]] + price[fits]
            best = int(v.argmax())
            value[c], pick[c] = (v[best], fits[best]) if v[best] > value[c - 1] else (value[c - 1], -1)
        if value[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= sizes[pick[c]]
        x, step = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column)
        ratio = np.full(k, np.inf)
        ratio[step > 1e-9] = np.maximum(x[step > 1e-9], 0) / step[step > 1e-9]
        basis[:, int(ratio.argmin())] = column
    x = np.floor(np.maximum(np.linalg.solve(basis, demand.astype(float)), 0) + 1e-6).astype(int)
    left, out = demand.astype(int).copy(), []
    for j in range(k):
        a = np.rint(basis[:, j]).astype(int)
        used = a > 0
        n = min(x[j], int((left[used] // a[used]).min())) if used.any() else 0
        if n:
            left -= a * n
            out.append((a, n))
    return out


def room_of(made: list[tuple[int, int]], capacity: int) -> int:
    return capacity - sum(n * m for n, m in made)


def refill(bins: list[tuple[list[tuple[int, int]], int]], rest: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """bins with the pieces of rest (length: how many) added, longest first, each where least room is left; works on counts of bins alike."""
    bins, by_room = list(bins), {}
    for k, (made, _) in enumerate(bins):
        by_room.setdefault(room_of(made, capacity), []).append(k)
    for n in sorted(rest, reverse=True):
        c = rest[n]
        while c:
            room = min((r for r, ks in by_room.items() if r >= n and ks), default=None)
            if room is None:
                fit = capacity // n
                full, part = divmod(c, fit)
                for times, m in ((full, fit), (1, part)):
                    if times and m:
                        bins.append(([(n, m)], times))
                        by_room.setdefault(capacity - n * m, []).append(len(bins) - 1)
                break
            k = by_room[room].pop()
            made, alike = bins[k]
            fit = min(room // n, c)
            times = min(alike, c // fit)
            if times < alike:
                bins.append((made, alike - times))
                by_room[room].append(len(bins) - 1)
            bins[k] = ([*made, (n, fit)], times)
            by_room.setdefault(room - n * fit, []).append(k)
            c -= fit * times
    return bins


def filled(bins: list[tuple[list[tuple[int, int]], int]], rest: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The fewest bins found: those of the configurations that substitution left with too much room are taken apart, and
    their pieces go in with the rest; "too much" is halved from the capacity on until the bound is met or it is nothing."""
    volume = sum(n * m * alike for made, alike in bins for n, m in made) + sum(n * c for n, c in rest.items())
    best, most = None, capacity
    while most and (best is None or sum(alike for _, alike in best) > -(-volume // capacity)):
        loose = dict(rest)
        for made, alike in bins:
            if room_of(made, capacity) >= most:
                for n, m in made:
                    loose[n] = loose.get(n, 0) + m * alike
        tried = refill([b for b in bins if room_of(b[0], capacity) < most], loose, capacity)
        if best is None or sum(alike for _, alike in tried) < sum(alike for _, alike in best):
            best = tried
        most //= 2
    return best or []


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first bin, pieces a bin, first offset) that place every piece."""
    bins: list[tuple[list[tuple[int, int]], int]] = []  # ([(length, how often)], bins alike)
    if counts.get(capacity):
        bins.append(([(capacity, 1)], counts[capacity]))
    large = sorted(((n, c) for n, c in counts.items() if capacity // 8 < n < capacity), reverse=True)
    rest = {n: c for n, c in counts.items() if n <= capacity // 8}
    each = max(1, -(-sum(c for _, c in large) // groups))
    queues: list[list[list[int]]] = []
    room = 0
    for n, c in large:
        while c:
            if not room:
                queues.append([])
                room = each
            take = min(c, room)
            queues[-1].append([n, take])
            c, room = c - take, room - take
    merged: list[list[list[int]]] = []
    for q in queues:  # groups of one rounded size are one
        if merged and merged[-1][0][0] == q[0][0]:
            merged[-1] += q
        else:
            merged.append(q)
    if merged:
        sizes, demand = np.array([q[0][0] for q in merged]), np.array([sum(c for _, c in q) for q in merged])
        for a, n in configurations(sizes, demand, capacity):
            used = [(g, int(a[g])) for g in np.flatnonzero(a)]
            while n:
                alike = min(n, *(merged[g][0][1] // m for g, m in used)) if used else 0
                made = []
                if alike:
                    for g, m in used:
                        made.append((merged[g][0][0], m))
                        merged[g][0][1] -= m * alike
                else:
                    alike = 1
                    for g, m in used:
                        for _ in range(m):
                            made.append((merged[g][0][0], 1))
                            merged[g][0][1] -= 1
                            if not merged[g][0][1]:
                                merged[g].pop(0)
                for g, _ in used:
                    if merged[g] and not merged[g][0][1]:
                        merged[g].pop(0)
                bins.append((made, alike))
                n -= alike
        for q in merged:
            for n, c in q:
                if c:
                    rest[n] = rest.get(n, 0) + c
    bins = filled(bins, rest, capacity)
    out, rank, first = [], dict.fromkeys(counts, 0), 0
    for made, alike in bins:
        at = 0
        for n, m in made:
            out.append((n, rank[n], alike * m, first, m, at))
            rank[n] += alike * m
            at += n * m
        first += alike
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """pieces (written already) -> pieces with sequence_id and offset."""
    counts = {int(n): int(c) for n, c in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = sorted(plan(counts, capacity, groups))
    before, total = {}, 0
    for n in sorted(counts):
        before[n] = total
        total += counts[n]
    first = np.zeros(capacity + 1, np.int64)
    first[list(before)] = list(before.values())
    shared = cut.sparkSession.sparkContext.broadcast((np.array(rows, np.int64).reshape(-1, 6), first))

    def place(batches):
        p, first = shared.value
        key = (p[:, 0] << 44) | p[:, 1]
        for batch in batches:
            n = batch.column("length").to_numpy()
            r = batch.column("rank").to_numpy() - first[n]
            row = p[np.searchsorted(key, (n << 44) | r, side="right") - 1]
            i = r - row[:, 1]
            bin_, offset = row[:, 3] + i // row[:, 4], row[:, 5] + i % row[:, 4] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bin_), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = cut.schema["doc_id"].dataType.simpleString()
    order = ranked(cut, "length", "doc_id", "piece", "ids_crc32", size="length")
    return order.select(*names, "rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return pack(durable(pieces(table(spark, sf_dir, "documents"), tokenizer_path())))
