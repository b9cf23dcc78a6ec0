"""Lines appended to growing files, as a streaming source.

``format("tail_lines")`` follows the files of a folder that driver and executors share.
An offset holds, for each file, how many bytes of whole lines have been read, so the
checkpoint of a query is its read position and a restart goes on from there. A file is
known by its inode and a checksum of its first line rather than by its name: one that
is renamed within the folder goes on from its place, and one that is cut off and
written anew, or that gets the inode of a deleted one, starts from its beginning.

Options: ``path`` (the folder); ``pattern`` of file names (``*``), which should also
fit the names that files get when they are rotated; ``from_end`` (``true``: leave out
what is there when the query first starts); ``split_bytes``, about how much of a file
one task reads at a trigger. A last line without its end waits for it. A file that is
deleted before a trigger has read it is lost, as for any reader of files.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, file_ms long, block long, line string"
BLOCK_BYTES, SPLIT_BYTES = 1 << 20, 64 << 20
#: A file is known from its first line on; of a longer one the beginning counts.
FIRST_BYTES = 4096


@dataclass
class Stretch(InputPartition):
    """Bytes ``begin`` to ``end`` of the file that ``key`` names; both follow ends of lines unless ``split``."""

    key: str
    path: str
    begin: int
    end: int


def _whole_lines(f, size: int) -> int:
    """The place after the last line end within ``size`` bytes, by blocks from the end."""
    at = size
    while at > 0:
        low = max(0, at - BLOCK_BYTES)
        f.seek(low)
        if (cut := f.read(at - low).rfind(b"\n")) >= 0:
            return low + cut + 1
        at = low
    return 0


def _key(f, stat: os.stat_result) -> str | None:
    """The identity of an open file, or None while its first line is not complete."""
    f.seek(0)
    head = f.read(FIRST_BYTES)
    first, end, _ = head.partition(b"\n")
    if not end and len(head) < FIRST_BYTES:
        return None
    return f"{stat.st_dev}-{stat.st_ino}-{zlib.crc32(first):08x}"


def listed(folder: str, pattern: str) -> dict[str, tuple[str, int]]:
    """key: (path, bytes of whole lines) of the folder's files as they are now."""
    out = {}
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        path = os.path.join(folder, name)
        if not fnmatchcase(name, pattern) or not os.path.isfile(path):
            continue
        try:
            with open(path, "rb") as f:
                stat = os.fstat(f.fileno())
                if key := _key(f, stat):
                    out[key] = path, _whole_lines(f, stat.st_size)
        except FileNotFoundError:  # renamed or deleted meanwhile
            continue
    return out


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, from_end: bool, split_bytes: int):
        self.folder, self.pattern, self.from_end, self.split_bytes = folder, pattern, from_end, split_bytes

    def _now(self) -> dict[str, int]:
        return {key: end for key, (_, end) in listed(self.folder, self.pattern).items()}

    def initialOffset(self) -> dict:
        return self._now() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._now()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found, out = listed(self.folder, self.pattern), []
        for key, stop in end.items():
            at = start.get(key, 0)
            at = 0 if at > stop else at  # cut off and written anew behind the same first line
            if key not in found or at == stop:
                continue
            path = found[key][0]
            cuts = [at]
            with open(path, "rb") as f:
                while stop - cuts[-1] > self.split_bytes:
                    f.seek(cuts[-1] + self.split_bytes)
                    f.readline()
                    cuts.append(min(f.tell(), stop))
            out += [Stretch(key, path, i, j) for i, j in zip(cuts, [*cuts[1:], stop], strict=True) if i < j]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Stretch):
            return
        with self._open(partition) as f:
            stat = os.fstat(f.fileno())
            f.seek(partition.begin)
            at, rest = partition.begin, b""
            while at < partition.end:
                data = f.read(min(BLOCK_BYTES, partition.end - at))
                if not data:
                    raise OSError(f"{partition.path} is shorter than the offset says")
                at += len(data)
                *lines, rest = (rest + data).split(b"\n")
                if lines:
                    n = len(lines)
                    texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
                    cols = [pa.array([partition.path] * n), pa.array([stat.st_mtime_ns // 1_000_000] * n), pa.array([partition.begin] * n), pa.array(texts, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=["file", "file_ms", "block", "line"])

    def _open(self, partition: Stretch):
        """The file by its identity, under whatever name it has by now."""
        for path in (partition.path, None):
            if path is None:
                found = listed(self.folder, self.pattern)
                if partition.key not in found:
                    raise FileNotFoundError(f"{partition.path} has gone before it was read")
                path = found[partition.key][0]
            try:
                f = open(path, "rb")  # noqa: SIM115  (the caller closes it)
            except FileNotFoundError:
                continue
            if _key(f, os.fstat(f.fileno())) == partition.key:
                return f
            f.close()
        raise FileNotFoundError(f"{partition.path} changed while it was read")

    def commit(self, end: dict) -> None:
        """Nothing is held beyond the offsets."""

    def stop(self) -> None:
        """Nothing to release."""


class TailLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        o = self.options
        return TailReader(o["path"].removeprefix("file://"), o.get("pattern", "*"), o.get("from_end", "false").lower() == "true", int(o.get("split_bytes", SPLIT_BYTES)))


def tail_stream(spark, folder: str, pattern: str = "*", from_end: bool = False):
    """(file, file_ms, block, line) of the lines of a folder's files as they grow; as ``text_stream`` for landed files."""
    spark.dataSource.register(TailLines)
    return spark.readStream.format("tail_lines").option("pattern", pattern).option("from_end", str(from_end).lower()).load(folder)
