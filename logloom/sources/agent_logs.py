"""The data source `agent_logs` (S1-S6, S8): log files of one tool as rows of lines, in batch and as a stream that reads only what was appended.

    spark.dataSource.register(AgentLogs)
    spark.read.format("agent_logs").option("tool", "codex").option("root", "/logs").load().where("day >= '2024-01-05' AND file_size < 1000000")

Files are listed once by the driver; predicates on tool, project, day, file_size and source_path prune that list before any file is opened
(spark.sql.python.filterPushdown.enabled). Tasks read pieces of files. A file that can't be read to its end gives a row with `error` in place of the rest of its lines; all others go on.
"""

from __future__ import annotations

import gzip
import re
import time
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from ..constants import TOOLS

SCHEMA = "tool string, source_path string, file_size bigint, day string, project string, block bigint, start bigint, value string, error string"
FIELDS = ("tool", "source_path", "file_size", "day", "project")
PIECE_BYTES, BATCH_LINES, BATCH_BYTES = 32 << 20, 4096, 4 << 20
DAY = re.compile(r"/sessions/(\d{4})/(\d{2})/(\d{2})/")


@dataclass(frozen=True)
class LogFile:
    tool: str
    path: str
    size: int
    changed: float

    @property
    def row(self) -> dict:
        """What is known of the file without opening it, as columns."""
        day = DAY.search(self.path)
        parts = self.path.split("/")
        project = parts[-3] if self.tool == "gemini" else parts[-2] if self.tool == "claude-code" else None
        return {"tool": self.tool, "source_path": shown(self.path), "file_size": self.size, "day": "-".join(day.groups()) if day else None, "project": project}


def shown(path: str) -> str:
    """Local paths as Spark's file metadata spells them."""
    return path if ":" in path.split("/")[0] else f"file:{path}"


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root.removeprefix("file:"))


def belongs(tool: str, inner: str) -> bool:
    """Whether a path below the root is a log of the tool; compressed ones too."""
    parts = inner.removesuffix(".gz").split("/")
    if not parts[-1].endswith(".jsonl"):
        return False
    if tool == "claude-code":
        return len(parts) <= 2
    return parts[-1].startswith("rollout-") if tool == "codex" else len(parts) == 3 and parts[1] == "chats" and parts[2].startswith("session-")


def listed(tool: str, root: str) -> list[LogFile]:
    if tool not in TOOLS:
        raise ValueError(f"unknown tool {tool!r}")
    fs, base = opened(root)
    base = base.rstrip("/")
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
    kept = [f for f in found if f.type == pafs.FileType.File and belongs(tool, f.path[len(base) :].lstrip("/"))]
    return sorted((LogFile(tool, f.path, f.size, (f.mtime_ns or 0) / 1e9) for f in kept), key=lambda f: f.path)


class Pieces(InputPartition):
    """Pieces (file, from, to) that one task reads; a line belongs to the piece that its first byte lies in."""

    def __init__(self, pieces: list[tuple[LogFile, int, int]]):
        self.pieces = pieces


def dealt(pieces: list[tuple[LogFile, int, int]], piece_bytes: int) -> list[Pieces]:
    """Large files cut, small ones grouped; a compressed file is one piece."""
    out, held, size = [], [], 0
    for file, a, b in pieces:
        step = max(1, b - a) if file.path.endswith(".gz") else piece_bytes
        for k in range(a, max(b, a + 1), step):
            held.append((file, k, min(b, k + step)))
            size += min(b, k + step) - k
            if size >= piece_bytes:
                out.append(Pieces(held))
                held, size = [], 0
    return [*out, Pieces(held)] if held else out


def lines_of(fs: pafs.FileSystem, file: LogFile, a: int, b: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start in [a, b)."""
    packed = file.path.endswith(".gz")
    with fs.open_input_file(file.path) as raw:
        if not packed:
            raw.seek(max(0, a - 1))
        read = gzip.GzipFile(fileobj=raw).read1 if packed else raw.read  # read1 gives what a cut file still holds
        at, rest, skip = (0 if packed else max(0, a - 1)), b"", not packed and a > 0
        while packed or at < b or skip:
            chunk = read(1 << 20)
            if not chunk:
                break
            whole = (rest + chunk).split(b"\n")
            rest = whole.pop()
            for line in whole:
                if skip:
                    skip = False
                elif packed or at < b:
                    yield at, line.removesuffix(b"\r")
                at += len(line) + 1
        if rest and not skip and (packed or at < b):
            yield at, rest.removesuffix(b"\r")


def batches_of(pieces: Pieces) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64() if n in ("file_size", "block", "start") else pa.string()) for n in (*FIELDS, "block", "start", "value", "error")])
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for file, a, b in pieces.pieces:
        row = tuple(file.row.values())
        at = a
        try:
            fs, _ = opened(file.path)
            for at, line in lines_of(fs, file, a, b):
                held.append((*row, a, at, line.decode("utf-8", "replace"), None))
                size += len(line)
                if len(held) >= BATCH_LINES or size >= BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
        except (OSError, EOFError, zlib.error) as error:
            held.append((*row, a, at, None, f"{type(error).__name__}: {error}"))
    if held:
        yield batch()


#: What a pushed predicate says of a file's column.
TESTS = {
    EqualTo: lambda v, x: v is not None and v == x, EqualNullSafe: lambda v, x: v == x, GreaterThan: lambda v, x: v is not None and v > x, GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    LessThan: lambda v, x: v is not None and v < x, LessThanOrEqual: lambda v, x: v is not None and v <= x, In: lambda v, x: v is not None and v in x, StringStartsWith: lambda v, x: v is not None and v.startswith(x),
    IsNull: lambda v, _: v is None, IsNotNull: lambda v, _: v is not None,
}


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.tool, self.root = options["tool"], options["root"]
        self.piece = int(options.get("pieceBytes", PIECE_BYTES))
        self.since, self.until = options.get("since"), options.get("until")
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                self.tests.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def files(self) -> list[LogFile]:
        """Files that pass the predicates and whose dated folder lies within since and until; undated ones stay."""
        out = []
        for f in listed(self.tool, self.root):
            row = f.row
            dated = row["day"] is None or ((not self.since or row["day"] >= self.since) and (not self.until or row["day"] <= self.until))
            if dated and all(TESTS[kind](row[name], value) for kind, name, value in self.tests):
                out.append(f)
        return out

    def partitions(self) -> Sequence[InputPartition]:
        return dealt([(f, 0, f.size) for f in self.files()], self.piece) or [Pieces([])]  # no partition at all would be read as None

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return batches_of(partition)


class TailReader(DataSourceStreamReader):
    """Offsets are bytes by file. A batch reads what lies between two offsets, whole lines only; an unfinished last line waits until it is finished or until the
    file has not changed for `settleSeconds`. A file that has become shorter gives nothing more until it passes its offset again."""

    def __init__(self, options: dict):
        self.tool, self.root = options["tool"], options["root"]
        self.piece = int(options.get("pieceBytes", PIECE_BYTES))
        self.settle = float(options.get("settleSeconds", 60))
        self.ends: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def _whole(self, file: LogFile) -> int:
        """Where the file's last whole line ends."""
        if file.path.endswith(".gz") or time.time() - file.changed >= self.settle:
            return file.size
        fs, _ = opened(file.path)
        end = file.size
        with fs.open_input_file(file.path) as raw:
            while end > 0:
                begin = max(0, end - (1 << 16))
                raw.seek(begin)
                at = raw.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def latestOffset(self) -> dict:
        out = {}
        for f in listed(self.tool, self.root):
            known = self.ends.get(f.path)
            if known is None or known[0] != f.size or known[1] < f.size:
                self.ends[f.path] = (f.size, self._whole(f))
            out[f.path] = self.ends[f.path][1]
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        grown = [(LogFile(self.tool, p, b, 0), start.get(p, 0), b) for p, b in sorted(end.items()) if b > start.get(p, 0)]
        return dealt([(f, 0 if f.path.endswith(".gz") else a, b) for f, a, b in grown], self.piece)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return batches_of(partition)

    def commit(self, end: dict) -> None:
        pass


class AgentLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "agent_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options)


def load(spark: SparkSession, tool: str, root: str, stream: bool = False, **options) -> DataFrame:
    """Lines of one tool's root by the data source, which is registered with pushed predicates on."""
    spark.dataSource.register(AgentLogs)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = (spark.readStream if stream else spark.read).format("agent_logs").option("tool", tool).option("root", root)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def readable(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with block_start, for `numbered`; a warning row for each file that could not be read to its end)."""
    lines = raw.where("error IS NULL").select("tool", "value", "source_path", "file_size", F.col("block").alias("block_start"))
    bad = raw.where("error IS NOT NULL").select("source_path", F.lit("file_unreadable").alias("code"))
    return lines, bad
