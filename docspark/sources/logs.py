"""Log files that grow, as a stream: a Python data source whose offsets are bytes read of each file."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of one partition, about: ranges are cut at line ends by their readers.
RANGE_BYTES = 32 << 20


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Tail(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Each file's length up to its last line end: a line still being written waits for its rest."""
        fs, base = _open(self.folder)
        out = {}
        for info in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
            if info.is_file and info.path.endswith(self.suffix) and (end := self._whole_lines(fs, info.path, info.size)):
                out[info.path] = end
        return out

    def _whole_lines(self, fs: pafs.FileSystem, path: str, size: int) -> int:
        step, end = 1 << 16, size
        with fs.open_input_file(path) as f:
            while end > 0:
                start = max(0, end - step)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, size in sorted(end.items()):
            begin = start.get(path, 0)
            out += [_Range(path, a, min(a + RANGE_BYTES, size)) for a in range(begin, size, RANGE_BYTES)]
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        """The lines that begin in the range; a line belongs to the range in which it begins."""
        fs, _ = _open(self.folder)
        with io.BufferedReader(fs.open_input_file(part.path)) as f:
            at = part.start
            if at:  # in the middle of a file, where the byte before is a line end or the line is another range's
                f.seek(at - 1)
                at = at - 1 + len(f.readline())
            f.seek(at)
            while at < part.end and (line := f.readline()):
                yield part.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """Format `log_tail`: file, offset and text of every line under `path` of files with `suffix` (`.log` unless told)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(self.options["path"], self.options.get("suffix", ".log"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)
