"""Spark data sources for byte streams.

`units`: units behind start codes, read by byte ranges, in batches or as files grow.  `samples`: samples of fragmented files, read by ranges
of fragments.  `ordered_files`: a sink that writes each stream's bytes into files whose numbers are in order.
register(spark) makes them known to a session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..common import ship
from . import annexb, mp4
from .files import Staged, listed, located, named, ranges, stream_of

SPLIT = 64 << 20
CODE = b"\0\0\1"
UNITS = "stream string, file string, offset long, size long, type int, layer int, tid int, rbsp binary, epb array<long>"
SAMPLES = "path string, fragment long, track int, index long, dts long, pts long, duration long, key boolean, timescale long, codec string, data binary"


# -- units by byte ranges


def units_between(f, start: int, end: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, unit) of the units whose start code begins in [start, end) of an open file; the last one is read past `end` to where it ends.

    Holds a unit and a chunk at most.  Start codes can't overlap, so that ranges side by side give each unit once.
    """
    f.seek(start)
    buffer, base, mark, look = b"", start, None, 0
    while True:
        at = buffer.find(CODE, look)
        while at < 0:
            if mark is None and base + len(buffer) >= end + 2:
                return
            more = f.read(chunk)
            if not more:
                break
            first = mark if mark is not None else max(len(buffer) - 2, 0)
            look = max(len(buffer) - 2, look) - first
            base, buffer, mark = base + first, buffer[first:] + more, 0 if mark is not None else None
            look = max(look, 0)
            at = buffer.find(CODE, look)
        if mark is not None:
            unit = buffer[mark + 3 : at if at >= 0 else len(buffer)].rstrip(b"\0")
            if len(unit) >= 2:
                yield base + mark + 3, unit
        if at < 0 or base + at >= end:
            return
        mark, look = at, at + 3


def last_code(f, start: int, end: int, chunk: int = 1 << 20) -> int | None:
    """Where the last start code of [start, end) begins."""
    while end > start:
        a = max(start, end - chunk)
        f.seek(a)
        at = f.read(end - a).rfind(CODE)
        if at >= 0:
            return a + at
        if a == start:
            return None
        end = a + 2
    return None


@dataclass
class Range(InputPartition):
    path: str
    stream: str | None
    start: int
    end: int
    wanted: dict[str, list] = field(default_factory=dict)



def _batches(rows: Iterator[tuple], schema: StructType, size: int = 500, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    to = to_arrow_schema(schema)
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= size or n >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), to)], schema=to)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), to)], schema=to)


def _unit_rows(part: Range, names: Sequence[str]) -> Iterator[tuple]:
    """Only what is asked for is worked out: payloads are freed of emulation prevention if rbsp or epb is."""
    where, at = located(part.path)
    deep = "rbsp" in names or "epb" in names
    with where.open_input_file(at) as f:
        for offset, unit in units_between(f, part.start, part.end):
            kind, layer, tid = annexb.header(unit)
            got = {"stream": part.stream, "file": part.path, "offset": offset, "size": len(unit), "type": kind, "layer": layer, "tid": tid}
            if any(got[c] not in v for c, v in part.wanted.items()):
                continue
            if deep:
                got["rbsp"], got["epb"] = annexb.payload(unit)
            yield tuple(got[n] for n in names)


def _wanted(options: dict, columns: Sequence[str]) -> dict[str, list]:
    """What options named like columns allow: a JSON list of values each."""
    return {c: json.loads(options[c]) for c in columns if c in options}


class UnitsReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.split, self.by_folder = options["path"], int(options.get("splitBytes", SPLIT)), options.get("streams", "files") == "folders"
        self.schema, self.wanted = schema, _wanted(options, ("stream", "type", "layer", "tid"))

    def partitions(self):
        wanted = dict(self.wanted)
        streams = wanted.pop("stream", None)
        out = []
        for path, size in listed(self.path):
            stream = stream_of(path) if self.by_folder else path
            if streams is None or stream in streams:
                out += [Range(path, stream, a, b, wanted) for a, b in ranges(size, self.split)]
        return out or [Range("", None, 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from _batches(_unit_rows(partition, self.schema.names), self.schema)


class UnitsStreamReader(DataSourceStreamReader):
    """Units of files that grow and are added to.  An offset says up to where each file has been read: to the last start code seen, as the unit
    behind it may go on; with option final, to the file's end.

    maxBytes: how much is admitted at a time (more where one unit is longer).  What has been admitted is written to the file that option `admitted` names, before
    Spark is told, so that a query that starts again goes on from there; Spark's own log decides what a batch reads, so nothing is lost
    or repeated.
    """

    def __init__(self, options: dict, schema: StructType):
        self.path, self.split, self.by_folder = options["path"], int(options.get("splitBytes", SPLIT)), options.get("streams", "files") == "folders"
        self.final, self.most, self.admitted = options.get("final", "false") == "true", int(options.get("maxBytes", 0)), options.get("admitted")
        if self.most and not self.admitted:
            raise ValueError("maxBytes needs a place to note what has been admitted: option admitted")
        self.schema = schema

    def initialOffset(self):
        return {}

    def _so_far(self) -> dict[str, int]:
        if not self.admitted:
            return {}
        where, at = located(self.admitted)
        try:
            with where.open_input_file(at) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {}

    def _end(self, path: str, start: int, size: int, budget: int | None) -> int:
        """Where to read a file to, of about as many bytes as the budget allows."""
        where, at = located(path)
        if budget is None or size - start <= budget:
            if self.final:
                return size
            budget = size - start
        with where.open_input_file(at) as f:
            cut = last_code(f, start + 1, start + budget)
            while cut is None and start + budget < size:  # one unit is longer than the budget
                budget *= 2
                cut = last_code(f, start + 1, min(start + budget, size))
        return cut if cut is not None else size if self.final else start

    def latestOffset(self):
        at = self._so_far()
        left = self.most or None
        for path, size in listed(self.path):
            start = at.get(path, 0)
            if size > start and left != 0:
                at[path] = self._end(path, start, size, left)
                left = left if left is None else max(0, left - (at[path] - start))
        if self.admitted:
            where, to = located(self.admitted)
            with where.open_output_stream(to + ".new") as f:
                f.write(json.dumps(at).encode())
            where.move(to + ".new", to)
        return at

    def partitions(self, start, end):
        out = []
        for path, size in sorted(end.items()):
            stream = stream_of(path) if self.by_folder else path
            out += [Range(path, stream, a, b) for a, b in ranges(size, self.split, start.get(path, 0))]
        return out

    def read(self, partition):
        yield from _batches(_unit_rows(partition, self.schema.names), self.schema)


class UnitsSource(DataSource):
    """Options: path; splitBytes (64 MB); streams: `files` (a stream is a file, named by its path) or `folders` (by the folder its files are in).

    Give a schema of fewer columns to read fewer: what isn't asked for isn't worked out.  Options stream, type, layer and tid, JSON lists of values, choose
    files, and units before their payload is looked at.  They aren't taken from the query's filters: Spark 4.1 keeps a filter that a
    Python source has taken for every other query on the same DataFrame.
    """

    @classmethod
    def name(cls):
        return "units"

    def schema(self):
        return UNITS

    def reader(self, schema):
        return UnitsReader(self.options, schema)

    def streamReader(self, schema):
        return UnitsStreamReader(self.options, schema)


# -- samples by ranges of fragments


@dataclass
class Fragments(InputPartition):
    path: str
    start: int
    end: int
    init: int  # where the first fragment begins: the init segment's end
    wanted: dict[str, list] = field(default_factory=dict)



def top_boxes(f, size: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of a file's outermost boxes, from their headers alone."""
    at = 0
    while at + 8 <= size:
        f.seek(at)
        head = f.read(16)
        n = int.from_bytes(head[:4], "big")
        n = int.from_bytes(head[8:16], "big") if n == 1 else size - at if n == 0 else n
        if n < 8 or at + n > size:
            return
        yield head[4:8], at, at + n
        at += n


class SamplesReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.split, self.schema = options["path"], int(options.get("splitBytes", SPLIT)), schema
        self.wanted = _wanted(options, ("files", "track", "key"))

    def partitions(self):
        wanted = dict(self.wanted)
        paths = wanted.pop("files", None)
        out = []
        for path, size in listed(self.path):
            if paths is not None and path not in paths:
                continue
            if not self.split or size <= self.split:
                out.append(Fragments(path, 0, size, 0, wanted))
                continue
            where, at = located(path)
            with where.open_input_file(at) as f:
                starts = [a for kind, a, _ in top_boxes(f, size) if kind == b"moof"]
            if not starts:
                out.append(Fragments(path, 0, size, 0, wanted))
                continue
            cuts = [starts[0]]
            for a in starts[1:]:
                if a - cuts[-1] >= self.split:
                    cuts.append(a)
            out += [Fragments(path, a, b, starts[0], wanted) for a, b in zip(cuts, [*cuts[1:], size])]
        return out or [Fragments("", 0, 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from _batches(_sample_rows(partition, self.schema.names), self.schema)


def _sample_rows(part: Fragments, names: Sequence[str]) -> Iterator[tuple]:
    where, at = located(part.path)
    with where.open_input_file(at) as f:
        init = f.read(part.init)
        f.seek(part.start)
        data = f.read(part.end - part.start)
    of = mp4.tracks(data) or mp4.tracks(init)
    for fragment, track, index, dts, pts, duration, key, x in mp4.fragments(data, init, part.start, part.start <= part.init):
        own = of.get(track, {})
        if dts is None:
            raise ValueError(f"{part.path}: a fragment at {fragment} has no decode time; read this file with splitBytes 0")
        got = {
            "path": part.path, "fragment": fragment, "track": track, "index": index, "dts": dts, "pts": pts, "duration": duration, "key": key,
            "timescale": own.get("timescale"), "codec": own.get("codec"), "data": x,
        }
        if all(got[c] in v for c, v in part.wanted.items()):
            yield tuple(got[n] for n in names)


class SamplesSource(DataSource):
    """Samples of media files.  Options: path; splitBytes (64 MB; 0: a file is one task).

    A file with fragments is cut where they begin, which its boxes' headers tell; each fragment must have a decode time then.  `index` counts the samples of a track within
    its fragment, at byte `fragment` of the file (-1: listed by the file's own tables).  Options files, track and key, JSON lists of
    values, choose files and samples.
    """

    @classmethod
    def name(cls):
        return "samples"

    def schema(self):
        return SAMPLES

    def reader(self, schema):
        return SamplesReader(self.options, schema)


# -- files in order


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def _written(out: Staged, batches: Iterator[pa.RecordBatch], name) -> Written:
    """One file for each stream in a task's rows, which must be sorted by it."""
    attempt, files, now, f = uuid.uuid4().hex, [], None, None
    try:
        for batch in batches:
            for stream, content in zip(batch.column("stream").to_pylist(), batch.column("content").to_pylist()):
                if f is None or stream != now:
                    if f is not None:
                        f.close()
                    now, own = stream, f"{named(stream)}/{name()}"
                    if any(own == x for _, x in files):
                        raise ValueError("rows must be sorted by stream within each partition")
                    f, place = out.open(attempt, own)
                    files.append(place)
                if content:
                    f.write(content)
    finally:
        if f is not None:
            f.close()
    return Written(files)


class OrderedFilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.out, self.suffix, self.overwrite = Staged(options["path"]), options.get("suffix", ".bin"), overwrite
        self.job = options.get("job", "")

    def write(self, iterator):
        part = TaskContext.get().partitionId()
        return _written(self.out, iterator, lambda: f"part-{self.job}{part:05d}{self.suffix}")

    def commit(self, messages):
        self.out.commit([x for m in messages if m for x in m.files], self.overwrite)

    def abort(self, messages):
        self.out.abort()


class OrderedFilesStreamWriter(DataSourceStreamArrowWriter):
    """A batch that comes again after a restart writes files of the same names again, so nothing is there twice."""

    def __init__(self, options: dict):
        self.out, self.suffix = Staged(options["path"]), options.get("suffix", ".bin")

    def write(self, iterator):
        part = TaskContext.get().partitionId()
        return _written(self.out, iterator, lambda: f"{part:05d}{self.suffix}")

    def commit(self, messages, batchId):
        numbered = lambda x: "/part-{:010d}-".format(batchId).join(x.rsplit("/", 1))
        self.out.commit([(a, numbered(b)) for m in messages if m for a, b in m.files])

    def abort(self, messages, batchId):
        self.out.abort()


class OrderedFiles(DataSource):
    """A sink for (stream, content): path/<stream>/part-<number><suffix>.  Options: path, suffix (.bin).

    Files are there once all tasks have succeeded: each task attempt writes into a staging folder, the driver moves what counts, and nothing but names goes through
    it.  A stream's bytes are its files' in order of their numbers if its rows were in order of partitions: write_in_order does that.
    """

    @classmethod
    def name(cls):
        return "ordered_files"

    def schema(self):
        return "stream string, content binary"

    def writer(self, schema, overwrite):
        return OrderedFilesWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite):
        return OrderedFilesStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the sources of this module known to a session."""
    ship(spark)
    for source in (UnitsSource, SamplesSource, OrderedFiles):
        spark.dataSource.register(source)


def read_units(spark: SparkSession, path: str, streams: str = "files", split_bytes: int = SPLIT, columns: Sequence[str] | None = None, **wanted: list) -> DataFrame:
    """As annexb.read_streams, but a file may be many tasks' work, and without nal_idx.  wanted: lists of the values of stream, type, layer or tid to read."""
    register(spark)
    reader = spark.read.format("units").option("streams", streams).option("splitBytes", split_bytes)
    for name, values in wanted.items():
        reader = reader.option(name, json.dumps(values))
    if columns:
        reader = reader.schema(", ".join(x for x in UNITS.split(", ") if x.split()[0] in columns))
    return reader.load(path)


def write_in_order(df: DataFrame, path: str, stream: str, order: Sequence[str], content: str, suffix: str = ".bin", mode: str = "append") -> None:
    """Writes each stream's content in order, as files whose numbers are in order.  A stream of any size is spread over tasks by ranges of its order."""
    register(df.sparkSession)
    by = [stream, *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).select(F.col(stream).cast("string").alias("stream"), F.col(content).cast("binary").alias("content"))
    rows.write.format("ordered_files").mode(mode).option("path", path).option("suffix", suffix).save()
