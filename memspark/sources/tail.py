"""A stream of the lines that are appended to files: each is read once, in ranges of bytes, and says where in its file it begins.

Structured Streaming's own file sources take a file as a whole when it appears and never look at it again; logs that grow need offsets by file and byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads, and that are read at once.
RANGE, BUFFER = 64 << 20, 1 << 20


class _Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int, first: bool):
        self.file, self.begin, self.end, self.first = file, begin, end, first


class TailReader(DataSourceStreamReader):
    """Offsets are, by file, how many bytes of whole lines have been read and a checksum of its first line. A file that is shorter than that, or begins otherwise, has been rotated and is read from its start."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith(("file:", "/")) else (fs.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, folder = self._fs()
        out = {}
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix) and info.size:
                with store.open_input_file(info.path) as file:
                    whole = _last_line_end(file, info.size)
                    if whole:
                        out[info.path] = [whole, _first_line(file)]
        return out

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for file, (size, first) in sorted(end.items()):
            read, before = start.get(file, (0, first))
            begin = 0 if size < read or before != first else read
            out += [_Range(file, at, min(size, at + RANGE), at == begin) for at in range(begin, size, RANGE)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        """The lines that begin in the range; the last one may end beyond it."""
        store, _ = self._fs()
        with store.open_input_file(partition.file) as file:
            at = partition.begin
            if not partition.first:
                at = _next_line(file, at - 1)
            file.seek(at)
            held = b""
            while at < partition.end:
                cut = held.find(b"\n")
                if cut < 0:
                    more = file.read(BUFFER)
                    if not more:
                        return
                    held += more
                    continue
                yield partition.file, at, held[:cut].decode("utf-8", "replace")
                at, held = at + cut + 1, held[cut + 1 :]


def _first_line(file) -> int:
    file.seek(0)
    return zlib.crc32(file.read(4096).split(b"\n", 1)[0])


def _last_line_end(file, size: int) -> int:
    """How many bytes there are up to and with the last line's end: what follows is still being written."""
    at = size
    while at > 0:
        begin = max(0, at - BUFFER)
        file.seek(begin)
        cut = file.read(at - begin).rfind(b"\n")
        if cut >= 0:
            return begin + cut + 1
        at = begin
    return 0


def _next_line(file, at: int) -> int:
    """Where the first line begins after a line's end at ``at`` or later."""
    file.seek(at)
    while block := file.read(BUFFER):
        cut = block.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(block)
    return at


class TailSource(DataSource):
    """Format ``tail``: the lines of the files in ``path`` (a folder that executors can open) whose names end in ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"))


def appended_lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """file, offset, value of the lines of a folder's files as they are appended; a line without an end waits for it. Order within a file is that of ``offset``."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("suffix", suffix).load(path)
