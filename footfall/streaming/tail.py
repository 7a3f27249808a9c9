"""A streaming source that follows growing text files by byte offsets.

The progress of a query is one byte offset per file, always at the end of a line, kept in the query's own checkpoint.
The driver lists files and looks for the last line break of those that have grown; tasks read the bytes, a long
stretch in several partitions. So a restart repeats and loses nothing, whatever was appended meanwhile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 20
_SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), ("value", pa.string())])


def _file_system(root: str):
    from pyarrow import fs

    if "://" not in root:
        return fs.LocalFileSystem(), root.removeprefix("file:")
    return fs.FileSystem.from_uri(root)


class Stretch(InputPartition):
    """Lines that begin in [start, end) of a file's new bytes [first, last)."""

    def __init__(self, path: str, first: int, start: int, end: int, last: int):
        self.path, self.first, self.start, self.end, self.last = path, first, start, end, last


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.names = options.get("names", "*")
        self.history = str(options.get("history", "false")).lower() == "true"
        self.stretch = int(options.get("stretch", 64 << 20))
        self.seen: dict[str, tuple[int, int]] = {}  # size of a file when last looked at, end of its last whole line

    def initialOffset(self) -> dict:
        return {} if self.history else self.latestOffset()

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = _file_system(self.root)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name[0] not in "._" and fnmatch(info.base_name, self.names):
                size, whole = self.seen.get(info.path, (0, 0))
                if info.size != size:
                    whole = self._last_line(system, info.path, whole if info.size > size else 0, info.size)
                found[info.path] = (info.size, whole)
        self.seen = found
        return {path: whole for path, (_, whole) in found.items()}

    @staticmethod
    def _last_line(system, path: str, known: int, size: int) -> int:
        """End of the last whole line in [known, size); `known` where there is none."""
        with system.open_input_file(path) as f:
            end = size
            while end > known:
                start = max(known, end - BLOCK)
                at = f.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return known

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        parts = []
        for path, last in sorted(end.items()):
            first = start.get(path, 0)
            if last < first:  # the file has been replaced by a shorter one
                first = 0
            parts += [Stretch(path, first, at, min(at + self.stretch, last), last) for at in range(first, last, self.stretch)]
        return parts

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.root)
        with system.open_input_file(partition.path) as f:
            at = partition.start
            skip = at > partition.first  # a line that begins earlier belongs to the stretch before
            if skip:
                at -= 1
            rest, begin = b"", at
            while at < partition.last and begin < partition.end:
                block = f.read_at(min(BLOCK, partition.last - at), at)
                if not block:
                    break
                at += len(block)
                *lines, rest = (rest + block).split(b"\n")
                starts, values = [], []
                for line in lines:
                    if skip:
                        skip = False
                    elif begin < partition.end:
                        starts.append(begin)
                        values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    begin += len(line) + 1
                if values:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition.path] * len(values)), pa.array(starts, pa.int64()), pa.array(values)], schema=_SCHEMA)


class TailSource(DataSource):
    """Format `footfall_tail`. Options: `path`, the root folder; `names`, a pattern of file names; `history`, true to
    begin with the lines that exist at the first start; `stretch`, the most bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "footfall_tail"

    def schema(self) -> str:
        return "path STRING, start BIGINT, value STRING"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(dict(self.options))
