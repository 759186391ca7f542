"""A data source of numbered text lines, read by byte ranges, and a capped scan that stops reading."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.session import written
from millrace.sources.tables import opened, paths_of

#: Bytes of a range, first of a capped scan and at most; lines of an Arrow batch and bytes read at once.
FIRST, MOST = 1 << 16, 64 << 20
ROWS, CHUNK = 10_000, 1 << 20
#: Endings of files that are one range, as no place inside can be found.
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")


@dataclass
class Range(InputPartition):
    """The lines of a file whose first byte is at `start` or after, and before `end`."""

    file: int
    path: str
    start: int
    end: int


def lines_of_range(part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line) without its line end. A line that began before `start` belongs to the range before."""
    with opened(part.path) as stream:
        at = part.start
        skip = at > 0
        if skip:  # a line begins at `start` only if the byte before ends one
            at -= 1
            stream.seek(at)
        left, begin = b"", at
        while True:
            chunk = stream.read(CHUNK)
            block = left + chunk
            first = 0
            while (end := block.find(b"\n", first)) >= 0:
                if not skip:
                    if begin >= part.end:
                        return
                    yield begin, block[first:end].removesuffix(b"\r")
                skip = False
                begin += end + 1 - first
                first = end + 1
            left = block[first:]
            if not chunk:
                if left and not skip and begin < part.end:
                    yield begin, left
                return
            if begin >= part.end:
                return


class LineReader(DataSourceReader):
    def __init__(self, ranges: list[list]) -> None:
        self.ranges = ranges

    def partitions(self) -> list[Range]:
        return [Range(*r) for r in self.ranges]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []

        def batch() -> pa.RecordBatch:
            offsets, lines = zip(*held, strict=True) if held else ((), ())
            columns = [pa.array([partition.file] * len(held), pa.int32()), pa.array(offsets, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["file", "offset", "value"])

        for row in lines_of_range(partition):
            held.append(row)
            if len(held) >= ROWS:
                yield batch()
        yield batch()


class LineSource(DataSource):
    """Lines of text as (file, offset, value): the option `ranges` is a JSON list of [file, path, start, end]."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "file int, offset long, value string"

    def reader(self, schema: object) -> LineReader:
        return LineReader(json.loads(self.options["ranges"]))


def files_of(spark: SparkSession, path: str) -> list[tuple[int, str, int]]:
    """(number, path, bytes) of a file, of the files in a folder, or of those that match a glob, in order of their names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for p in paths_of(spark, path):
        where = jvm.org.apache.hadoop.fs.Path(p)
        system = where.getFileSystem(conf)
        statuses = system.listStatus(where) if system.getFileStatus(where).isDirectory() else [system.getFileStatus(where)]
        found += [(s.getPath().toString(), s.getLen()) for s in statuses if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    return [(i, p, size) for i, (p, size) in enumerate(sorted(found))]


def ranges_from(files: list[tuple[int, str, int]], at: tuple[int, int], size: int, count: int) -> tuple[list[list], tuple[int, int]]:
    """The next `count` ranges of `size` bytes from a place (file number, offset) on, and the place after them."""
    ranges: list[list] = []
    file, offset = at
    while file < len(files) and len(ranges) < count:
        number, path, length = files[file]
        end = length if path.endswith(COMPRESSED) else min(length, offset + size)
        if end > offset or path.endswith(COMPRESSED):
            ranges.append([number, path, offset, max(end, offset + 1) if not path.endswith(COMPRESSED) else 1 << 62])
        offset = end
        if offset >= length:
            file, offset = file + 1, 0
    return ranges, (file, offset)


def read_ranges(spark: SparkSession, ranges: list[list]) -> DataFrame:
    """file, offset and value of the lines of the given ranges."""
    spark.dataSource.register(LineSource)
    return spark.read.format(LineSource.name()).option("ranges", json.dumps(ranges)).load()


def read_lines(spark: SparkSession, path: str, size: int = MOST) -> DataFrame:
    """All lines, (file, offset) being their order."""
    files = files_of(spark, path)
    return read_ranges(spark, ranges_from(files, (0, 0), size, 1 << 62)[0])


@dataclass
class Capped:
    """Lines that a capped scan kept, and what it read for them."""

    lines: DataFrame
    kept: int
    lines_read: int
    bytes_read: int


def read_capped(spark: SparkSession, path: str, limit: int, wanted: str = "true", first: int = FIRST, most: int = MOST) -> Capped:
    """The first `limit` lines, in file order, for which the SQL condition `wanted` (over `value`) holds.

    Files are read in waves of byte ranges, from the front. What the lines seen so
    far weigh says how many bytes the missing ones need, so the second wave mostly
    is the last; nothing behind it is opened. A wave's lines are written once to the
    shared folder, and only the range in which the limit falls is cut by its
    offsets. Ranges are as many as the session's parallelism at least, if there is so
    much to read, and no larger than `most`.
    """
    files = files_of(spark, path)
    width = spark.sparkContext.defaultParallelism
    place, waves, kept, lines_read, bytes_read = (0, 0), [], 0, 0, 0
    size, count = first, 1
    while kept < limit and place[0] < len(files):
        ranges, after = ranges_from(files, place, size, count)
        if not ranges:
            break
        seen = Observation()
        rows = read_ranges(spark, ranges).observe(seen, F.count(F.lit(1)).alias("n")).filter(wanted)
        wave = written(rows, "lines")
        n = wave.count()
        # Bytes between the two places, whole files included.
        read = sum(files[i][2] for i in range(place[0], after[0])) + after[1] - place[1]
        lines_read, bytes_read = lines_read + seen.get["n"], bytes_read + read
        if kept + n > limit:
            wave = first_lines(wave, limit - kept)
        waves.append(wave)
        kept, place = min(limit, kept + n), after
        weight = bytes_read / kept if kept else 0
        missing = int(weight * (limit - kept) * 1.05) + first if kept else 4 * bytes_read
        size = max(first, min(most, -(-missing // width)))
        count = max(1, -(-missing // size))
    lines = waves[0] if waves else spark.createDataFrame([], "file int, offset long, value string")
    for wave in waves[1:]:
        lines = lines.union(wave)
    return Capped(lines, kept, lines_read, bytes_read)


def first_lines(lines: DataFrame, limit: int, part: int = 1 << 20) -> DataFrame:
    """The first `limit` of lines by (file, offset); counts by file and megabyte say where the limit falls, and only there lines are put in order."""
    spans = lines.groupBy("file", F.expr(f"offset div {part}L").alias("span")).agg(F.count(F.lit(1)).alias("n")).orderBy("file", "span")
    before = 0
    for row in spans.toLocalIterator():  # one row for each megabyte of a wave, fetched until the limit is met
        if before + row.n >= limit:
            here = (F.col("file") == row.file) & (F.expr(f"offset div {part}L") == row.span)
            cut = lines.filter(here).orderBy("offset").limit(limit - before)
            earlier = (F.col("file") < row.file) | ((F.col("file") == row.file) & (F.expr(f"offset div {part}L") < row.span))
            return lines.filter(earlier).union(cut)
        before += row.n
    return lines
