"""Growing text files as streaming sources: logs by line, event streams by payload.

An offset is how many bytes of each file have been read. It moves by whole lines, so a
restart from a checkpoint neither loses nor repeats one, and a half-written line waits
for its end. Files may be in any store that pyarrow knows by its address.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship

#: Bytes that are looked through at a time.
PIECE = 1 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.suffix = options.get("suffix", "")
        self.stop = options.get("end", "").encode()
        self.most = int(options.get("maxbytespartition", 1 << 26))
        #: Where a file's end marker was found; it is read no further.
        self.closed: dict[str, int] = {}

    def _files(self) -> dict[str, int]:
        from pyarrow import fs

        store, root = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_"))}

    def _upto(self, path: str, start: int, size: int) -> int:
        """The end of the last whole line, or of the line with the end marker."""
        store, _ = _store(self.folder)
        with store.open_input_file(path) as f:
            if self.stop:
                at, carry = start, b""
                while at < size:
                    piece = carry + f.read_at(min(PIECE, size - at), at)
                    begin = at - len(carry)
                    at += len(piece) - len(carry)
                    if (k := piece.find(self.stop)) >= 0:
                        line = piece.find(b"\n", k)
                        if line >= 0:
                            self.closed[path] = begin + line + 1
                            return self.closed[path]
                    carry = piece[-(len(self.stop) + 4096) :]
            at = size
            while at > start:
                low = max(start, at - PIECE)
                k = f.read_at(at - low, low).rfind(b"\n")
                if k >= 0:
                    return low + k + 1
                at = low
        return start

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path, size in self._files().items():
            known = self.seen.get(path, 0) if hasattr(self, "seen") else 0
            out[path] = self.closed.get(path) or (self._upto(path, known, size) if size > known else known)
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, upto in sorted(end.items()):
            at = start.get(path, 0)
            while at < upto:
                out.append(_Stretch(path, at, min(upto, at + self.most)))
                at += self.most
        return out

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        """The lines that begin in the stretch."""
        store, _ = _store(self.folder)
        with store.open_input_file(partition.path) as f:
            size, at, rest = f.size(), partition.start, b""
            # A stretch that begins inside a line leaves it to the one before.
            skip = at > 0 and f.read_at(1, at - 1) != b"\n"
            begin = at
            while begin < partition.end and at < size:
                piece = f.read_at(min(PIECE, size - at), at)
                at += len(piece)
                lines = (rest + piece).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if begin >= partition.end:
                        return
                    if not skip:
                        yield partition.path, begin, line.removesuffix(b"\r").decode("utf-8", "replace")
                    skip = False
                    begin += len(line) + 1


class GrowingLines(DataSource):
    """Format "growing_lines": the lines of all files under a folder, as they are written.

    Columns: path, at (the line's first byte) and value. Options: ``suffix`` of file names;
    ``end``, a marker after whose line a file is read no further.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, at long, value string"

    def streamReader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def log_lines(spark: SparkSession, folder: str, suffix: str = "", end: str = "") -> DataFrame:
    """A stream of the lines of growing files."""
    ship(spark)
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("suffix", suffix).option("end", end).load(folder)


def event_payloads(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """A stream of path, at and payload: the JSON of ``data:`` lines, each file up to its ``data: [DONE]``."""
    lines = log_lines(spark, folder, suffix, "data: [DONE]")
    body = F.trim(F.regexp_extract("value", r"^\s*data:(.*)$", 1))
    return lines.select("path", "at", body.alias("payload")).filter((F.col("payload") != "") & (F.col("payload") != "[DONE]") & F.try_parse_json("payload").isNotNull())

