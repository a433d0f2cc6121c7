"""Growing log files as a stream: what is appended to a file becomes rows, wherever in the file a batch ends.

The source is written on Spark's Python data sources.  Its offset is a map of
path to byte position.  A line belongs to the range of bytes that holds its line
end, so that a line which is still being written comes out whole, once, in the
batch in which it ends, and large files are read in several tasks.  A file that
is shorter than its position has been replaced: all its lines are new.  A restart
from a checkpoint goes on where the offsets say, whatever has happened meanwhile.

A folder is a local or shared one, or the address of an object store or HDFS
(read by pyarrow's file systems).  A file that has shrunk and grown
beyond its position between two batches can't be told from one that has grown.
The offset has one number a file, by its path below the folder.  Small files
share a task, and a batch has TASKS tasks at most, however many its files are.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, position long, value string"
#: Bytes that one task reads, that one read takes, and that a batch of rows holds; tasks of a batch, and bytes that could be read while a file is opened.
TASK, READ, ROWS, TASKS, OPEN = 128 << 20, 1 << 20, 4 << 20, 1000, 64 << 10


@dataclass
class Range:
    path: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What one task reads, range after range."""

    ranges: list[Range]


def dealt(changed: list[Range], task: int) -> list[Ranges]:
    """Changed ranges of files cut to ``task`` bytes (more, if that made over TASKS pieces) and put together, in their order, to about TASKS tasks at most."""
    step = max(task, sum(r.end - r.start for r in changed) // TASKS + 1)
    pieces = [Range(r.path, a, min(a + step, r.end)) for r in changed for a in range(r.start, r.end, step)]
    room = max(task, sum(p.end - p.start + OPEN for p in pieces) // TASKS + 1)
    out: list[Ranges] = []
    used = room
    for p in pieces:
        weight = p.end - p.start + OPEN
        if used + weight > room:
            out.append(Ranges([]))
            used = 0
        out[-1].ranges.append(p)
        used += weight
    return out


def _remote(root: str):
    """The file system of an address (None for a local or shared folder), and the path in it."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    if "://" not in root:
        return None, root
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def list_sizes(root: str, glob: str) -> dict[str, int]:
    """Path and size of each file of such a name below ``root``, by path."""
    files, root = _remote(root)
    if files is None:
        found = []
        for folder, _, names in os.walk(root):
            for name in fnmatch.filter(names, glob):
                try:
                    found.append((f"{folder}/{name}", os.path.getsize(f"{folder}/{name}")))
                except FileNotFoundError:
                    pass  # removed meanwhile
        return dict(sorted(found))
    from pyarrow import fs

    infos = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {i.path: i.size for i in sorted(infos, key=lambda i: i.path) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, glob)}


def open_file(root: str, path: str):
    """A file below ``root`` for reading, and its size."""
    files, _ = _remote(root)
    if files is None:
        return open(path, "rb"), os.path.getsize(path)
    f = files.open_input_file(path)
    return f, f.size()


def _line_start(f, position: int) -> int:
    """Where the line begins that holds the byte at ``position``."""
    end = position
    while end > 0:
        begin = max(0, end - READ)
        f.seek(begin)
        at = f.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


def lines_between(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Position and bytes of each line whose line end lies in [start, end)."""
    begin = _line_start(f, start)
    f.seek(begin)
    rest, at = [], begin
    while at < end:
        data = f.read(min(READ, end - at))
        if not data:
            return  # the file has shrunk since; its next range begins at 0
        at += len(data)
        first, *more = data.split(b"\n")
        rest.append(first)
        for piece in more:
            line = b"".join(rest)
            yield begin, line
            begin += len(line) + 1
            rest = [piece]


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob", "*")
        self.task = int(options.get("bytesPerTask", TASK))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        root = self._prefix()
        return {path.removeprefix(root): size for path, size in list_sizes(self.root, self.glob).items()}

    def _prefix(self) -> str:
        return _remote(self.root)[1].rstrip("/") + "/"

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        root, changed = self._prefix(), []
        for path, size in end.items():
            # offsets of earlier checkpoints have whole paths
            whole = path if path.startswith(root) else root + path
            begin = start.get(path, start.get(whole, 0))
            if size != begin:
                changed.append(Range(whole, begin if size > begin else 0, size))
        return dealt(changed, self.task)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        """Lines of several ranges come in batches of their own, of about ROWS bytes."""
        rows: list[tuple[str, int, str]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["path", "position", "value"])

        for r in partition.ranges:
            f, there = open_file(self.root, r.path)
            with f:
                for position, line in lines_between(f, r.start, min(r.end, there)):
                    if not line.strip():
                        continue
                    rows.append((r.path, position, line.decode("utf-8", "replace")))
                    size += len(line)
                    if size > ROWS:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class TailSource(DataSource):
    """Options: path (a folder), glob (of file names, all by default) and bytesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, folder: str, glob: str = "*", bytes_per_task: int = TASK) -> DataFrame:
    """A stream of the lines that are written below ``folder``: path, position (the byte where a line begins) and value."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("glob", glob).option("bytesPerTask", bytes_per_task).load(folder)


def as_places(lines: DataFrame) -> DataFrame:
    """Tailed lines as the normalizers take them: path, place and value."""
    return lines.select("path", F.struct(F.col("position").alias("_block"), F.lit(0).cast("long").alias("_id")).alias("place"), "value")
