"""A data source for text files whose records begin with a marker, read by byte ranges.

A record belongs to the range that holds the first byte of its marker; its reader goes on beyond the range as far as
the next marker, so one huge file is read by many tasks and every record comes once, whatever the ranges.  Text before
the first marker of a file is no record.  A compressed file cannot be entered in the middle and is one range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 128 << 20
CHUNK_BYTES = 4 << 20
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")


@dataclass
class ByteRange(InputPartition):
    uri: str
    start: int
    end: int


def records(stream, marker: bytes, start: int, end: int, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the records whose marker begins in ``[start, end)``; ``stream`` stands at ``start``.

    Memory is one record and one chunk; every byte is searched once.
    """
    held, base, look, inside = bytearray(), start, 0, False
    while True:
        found = held.find(marker, look)
        if found >= 0:
            if inside:
                yield base, bytes(held[:found])
            base += found
            del held[:found]
            if base >= end:
                return
            inside, look = True, len(marker)
            continue
        # the marker may begin in the last bytes
        look = max(look, len(held) - len(marker) + 1)
        if not inside:
            base += look
            del held[:look]
            look = 0
            if base >= end:
                return
        more = stream.read(chunk)
        if not more:
            if inside:
                yield base, bytes(held)
            return
        held += more


def _overlaps_itself(marker: bytes) -> bool:
    return any(marker.startswith(marker[i:]) for i in range(1, len(marker)))


class MarkedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.marker = options["marker"].encode()
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        if not self.marker or _overlaps_itself(self.marker):
            raise ValueError("the marker must not be empty or overlap itself")
        if self.split_bytes < 1:
            raise ValueError("split_bytes must be at least 1")

    def partitions(self) -> list[ByteRange]:
        """Ranges of all files at or below the path; names that begin with ``.`` or ``_`` are skipped."""
        from pyarrow import fs as afs

        files, where = _file_system(self.path)
        info = files.get_file_info(where)
        if info.type == afs.FileType.NotFound:
            raise ValueError(f"no such path: {self.path}")
        if info.type == afs.FileType.File:
            found = [info]
        else:
            found = files.get_file_info(afs.FileSelector(where, recursive=True))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            below = f.path[len(where) :].split("/") if f is not info else []
            if f.type != afs.FileType.File or any(p[:1] in (".", "_") for p in below):
                continue
            step = max(1, f.size) if f.path.endswith(COMPRESSED) else self.split_bytes
            out += [ByteRange(f.path, a, min(a + step, f.size)) for a in range(0, f.size, step)]
        return out

    def read(self, partition: ByteRange) -> Iterator[tuple[str, int, str]]:
        files, _ = _file_system(self.path)
        if partition.uri.endswith(COMPRESSED):
            stream, end = files.open_input_stream(partition.uri, compression="detect"), 1 << 62
        else:
            stream, end = files.open_input_file(partition.uri), partition.end
            stream.seek(partition.start)
        with stream:
            for place, value in records(stream, self.marker, partition.start, end):
                yield partition.uri, place, value.decode("utf-8", "replace")


def _file_system(path: str):
    """File system and plain path of a path or URI."""
    from pyarrow import fs as afs

    if "://" not in path and not path.startswith("file:"):
        return afs.LocalFileSystem(), path
    return afs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and path[5:8] != "///" else path)


class MarkedRecords(DataSource):
    """``spark.read.format("marked_records").option("marker", ...).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "marked_records"

    def schema(self) -> str:
        return "file string, place bigint, value string"

    def reader(self, schema) -> MarkedReader:
        return MarkedReader(self.options)


def read_marked(spark: SparkSession, path: str, marker: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(file, place, value)``: every record from its marker to the next one or the end of the file."""
    spark.dataSource.register(MarkedRecords)
    return spark.read.format("marked_records").option("marker", marker).option("split_bytes", str(split_bytes)).load(path)
