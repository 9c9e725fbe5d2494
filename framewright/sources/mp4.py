"""ISO base media files: boxes, decode times, sample tables, and writing fragments."""

from __future__ import annotations

import functools
import itertools
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..common import folded, ship, spread

SAFE = (1 << 53) - 1
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"moof", b"traf", b"mvex", b"dinf", b"edts"))


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of the content, end) of the boxes side by side; stops at one that is cut off."""
    end = len(data) if end is None else end
    at = start
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def find(data: bytes, path: Sequence[bytes], start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Contents of all boxes at this path."""
    if not path:
        return [(start, len(data) if end is None else end)]
    return [x for kind, a, b in boxes(data, start, end) if kind == path[0] for x in find(data, path[1:], a, b)]


def is_init(data: bytes, moov: bool = True) -> bool:
    """Whether data starts with an init segment: an ftyp box, or also a moov box."""
    return data[4:8] == b"ftyp" or moov and data[4:8] == b"moov"


def decode_time(data: bytes) -> int | None:
    """The base decode time of the only track fragment; None if there isn't exactly one, or it is odd or too large."""
    fragments = find(data, (b"moof", b"traf"))
    if len(fragments) != 1:
        return None
    times = find(data, (b"tfdt",), *fragments[0])
    if not times:
        return None
    a, b = times[0]
    version = data[a] if a < b else 2
    size = {0: 4, 1: 8}.get(version)
    if size is None or a + 4 + size > b:
        return None
    value = int.from_bytes(data[a + 4 : a + 4 + size], "big")
    return value if value <= SAFE else None


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I", len(body) + 8) + kind + body


def full_box(kind: bytes, version: int, flags: int, *content: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *content)


def tfdt(time: int) -> bytes:
    """A decode time box: 32 bits where they suffice, else 64."""
    return full_box(b"tfdt", 0, 0, struct.pack(">I", time)) if time <= 0xFFFFFFFF else full_box(b"tfdt", 1, 0, struct.pack(">Q", time))


def descriptor(tag: int, body: bytes) -> bytes:
    """A descriptor with its length in groups of seven bits."""
    n, groups = len(body), []
    while True:
        groups.append(n & 127)
        n >>= 7
        if not n:
            break
    return bytes([tag, *(g | 128 for g in reversed(groups[1:])), groups[0]]) + body


def fragment(sequence: int, tracks: Sequence[tuple[int, int, Sequence[tuple[bytes, int, bool]]]]) -> bytes:
    """A moof and its mdat.  tracks: (id, decode time, samples (data, duration, key)); a track's data follows the one before it."""

    def moof(offsets: Sequence[int]) -> bytes:
        parts = [full_box(b"mfhd", 0, 0, struct.pack(">I", sequence))]
        for (track, time, samples), offset in zip(tracks, offsets):
            entries = b"".join(struct.pack(">III", d, len(x), 0x02000000 if key else 0x01010000) for x, d, key in samples)
            run = full_box(b"trun", 0, 0x000701, struct.pack(">II", len(samples), offset), entries)
            parts.append(box(b"traf", full_box(b"tfhd", 0, 0x020000, struct.pack(">I", track)), tfdt(time), run))
        return box(b"moof", *parts)

    at, offsets = len(moof([0] * len(tracks))) + 8, []
    for _, _, samples in tracks:
        offsets.append(at)
        at += sum(len(x) for x, _, _ in samples)
    return moof(offsets) + box(b"mdat", *(x for _, _, samples in tracks for x, _, _ in samples))


def samples(data: bytes) -> list[tuple[int, int, int, int, bool, bytes]]:
    """(track, index, decode time, duration, key, data) of every sample of the fragments that fragment() writes."""
    out = []
    for kind, a, b in boxes(data):
        if kind != b"moof":
            continue
        start = a - 8
        for ta, tb in find(data, (b"traf",), a, b):
            (ha, _), = find(data, (b"tfhd",), ta, tb)
            track = int.from_bytes(data[ha + 4 : ha + 8], "big")
            (da, _), = find(data, (b"tfdt",), ta, tb)
            time = int.from_bytes(data[da + 4 : da + (12 if data[da] else 8)], "big")
            for ra, _ in find(data, (b"trun",), ta, tb):
                n, at = struct.unpack(">Ii", data[ra + 4 : ra + 12])
                at += start
                for i in range(n):
                    duration, size, flags = struct.unpack(">III", data[ra + 12 + 12 * i : ra + 24 + 12 * i])
                    out.append((track, i, time, duration, not flags & 0x10000, data[at : at + size]))
                    time, at = time + duration, at + size
    return out


# -- reading any file


def _number(data: bytes, at: int, size: int = 4) -> int:
    return int.from_bytes(data[at : at + size], "big")


def tracks(data: bytes) -> dict[int, dict]:
    """What moov says of each track: timescale, handler, codec, width, height, and the defaults of its fragments."""
    out: dict[int, dict] = {}
    for a, b in find(data, (b"moov", b"trak")):
        (ha, _), (ma, _), (ka, _) = (find(data, path, a, b)[0] for path in ((b"tkhd",), (b"mdia", b"mdhd"), (b"mdia", b"hdlr")))
        wide = data[ha] == 1
        track = _number(data, ha + (20 if wide else 12))
        at = ha + (88 if wide else 76)
        entry = find(data, (b"mdia", b"minf", b"stbl", b"stsd"), a, b)
        codec = data[entry[0][0] + 12 : entry[0][0] + 16].decode("latin-1") if entry and entry[0][1] - entry[0][0] >= 16 else None
        out[track] = {
            "timescale": _number(data, ma + (20 if data[ma] == 1 else 12)), "handler": data[ka + 8 : ka + 12].decode("latin-1"), "codec": codec,
            "width": _number(data, at) >> 16, "height": _number(data, at + 4) >> 16, "duration": 0, "size": 0, "flags": 0, "place": (a, b),
        }
    for a, _ in find(data, (b"moov", b"mvex", b"trex")):
        if own := out.get(_number(data, a + 4)):
            own |= {"duration": _number(data, a + 12), "size": _number(data, a + 16), "flags": _number(data, a + 20)}
    return out


def demux(data: bytes, init: bytes = b"") -> Iterator[tuple[int, int, int, int, int, bool, bytes]]:
    """(track, index, dts, pts, duration, key, data) of all samples, of fragments and of the tables in moov.

    init: the init segment of data, if that has none of its own.  A fragment's fields come from its runs, or else its header, or
    else the track's defaults.  A sample that is cut off ends its run.
    """
    count: dict[int, int] = {}
    for fragment, track, index, *rest in fragments(data, init):
        yield track, index if fragment < 0 else count.get(track, 0), *rest
        count[track] = count.get(track, 0) + (fragment >= 0)


def fragments(data: bytes, init: bytes = b"", at: int = 0, first: bool = True) -> Iterator[tuple[int, int, int, int | None, int | None, int, bool, bytes]]:
    """(fragment, track, index in it, dts, pts, duration, key, data); data are the bytes of a file from `at` on, where a fragment begins.

    fragment: where in the file it begins, or -1 for samples that moov lists.  Time begins at 0 with a file's first fragment; in a part that begins with
    another one, dts is null until a fragment tells it.
    """
    known = tracks(data) or tracks(init)
    for track, own in tracks(data).items():
        for row in _from_tables(data, track, *own["place"]):
            yield -1, *row
    clock: dict[int, int | None] = {} if first else dict.fromkeys(known)
    for kind, a, b in boxes(data):
        if kind != b"moof":
            continue
        count: dict[int, int] = {}
        start, end_of_last = a - 8, None
        for ta, tb in find(data, (b"traf",), a, b):
            heads = find(data, (b"tfhd",), ta, tb)
            if not heads:
                continue
            p = heads[0][0]
            flags, track = _number(data, p) & 0xFFFFFF, _number(data, p + 4)
            own, p, base = dict(known.get(track, {})), p + 8, None
            for bit, size, name in ((1, 8, "base"), (2, 4, "entry"), (8, 4, "duration"), (16, 4, "size"), (32, 4, "flags")):
                if flags & bit:
                    own[name] = _number(data, p, size)
                    p += size
            base = own["base"] - at if flags & 1 else start if flags & 0x20000 or end_of_last is None else end_of_last
            for da, _ in find(data, (b"tfdt",), ta, tb):
                clock[track] = _number(data, da + 4, 8 if data[da] else 4)
            where = base
            for ra, _ in find(data, (b"trun",), ta, tb):
                version, bits, n = data[ra], _number(data, ra) & 0xFFFFFF, _number(data, ra + 4)
                p = ra + 8
                if bits & 1:
                    where = base + struct.unpack(">i", data[p : p + 4])[0]
                    p += 4
                first = _number(data, p) if bits & 4 else None
                p += 4 if bits & 4 else 0
                for i in range(n):
                    got = {}
                    for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")):
                        if bits & bit:
                            got[name] = _number(data, p)
                            p += 4
                    shift = got.get("shift", 0)
                    shift -= (1 << 32) if version and shift >> 31 else 0
                    mark = first if first is not None and not i else got.get("flags", own.get("flags", 0))
                    duration, size = (got.get(k, own.get(k, 0)) for k in ("duration", "size"))
                    if where + size > len(data):
                        break
                    dts = clock.get(track, 0)
                    told = (dts, dts + shift) if dts is not None else (None, None)
                    yield at + start, track, count.get(track, 0), *told, duration, not mark & 0x10000, data[where : where + size]
                    count[track], where = count.get(track, 0) + 1, where + size
                    clock[track] = dts + duration if dts is not None else None
            end_of_last = where


def _from_tables(data: bytes, track: int, a: int, b: int) -> Iterator[tuple]:
    """Samples that moov lists itself."""
    at = {k: x[0][0] for k in (b"stts", b"ctts", b"stsc", b"stsz", b"stco", b"co64", b"stss") if (x := find(data, (b"mdia", b"minf", b"stbl", k), a, b))}
    if b"stsz" not in at or not (n := _number(data, at[b"stsz"] + 8)):
        return
    same = _number(data, at[b"stsz"] + 4)
    sizes = [same or _number(data, at[b"stsz"] + 12 + 4 * i) for i in range(n)]

    def spread(kind: bytes, signed: bool = False) -> list[int]:
        if kind not in at:
            return [0] * n
        rows = struct.iter_unpack(">Ii" if signed else ">II", data[at[kind] + 8 : at[kind] + 8 + 8 * _number(data, at[kind] + 4)])
        return [v for c, v in rows for _ in range(c)]

    steps, shifts = spread(b"stts"), spread(b"ctts", signed=True)
    keys = {_number(data, at[b"stss"] + 8 + 4 * i) for i in range(_number(data, at[b"stss"] + 4))} if b"stss" in at else None
    wide = 8 if b"co64" in at else 4
    offsets = at.get(b"co64", at.get(b"stco"))
    chunks = [_number(data, offsets + 8 + wide * i, wide) for i in range(_number(data, offsets + 4))]
    runs = list(struct.iter_unpack(">III", data[at[b"stsc"] + 8 : at[b"stsc"] + 8 + 12 * _number(data, at[b"stsc"] + 4)]))
    i = dts = 0
    for c, where in enumerate(chunks, 1):
        per = next(k for first, k, _ in reversed(runs) if first <= c)
        for _ in range(min(per, n - i)):
            if where + sizes[i] > len(data):
                return
            yield track, i, dts, dts + shifts[i], steps[i], keys is None or i + 1 in keys, data[where : where + sizes[i]]
            dts, where, i = dts + steps[i], where + sizes[i], i + 1


SAMPLES = "path string, track int, index long, dts long, pts long, duration long, key boolean, timescale long, codec string, data binary"
TRACKS = "path string, track int, handler string, codec string, timescale long, width int, height int"


def _rows_of(files: DataFrame, schema: str, rows) -> DataFrame:
    ship(files.sparkSession)
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            files = zip(*(c.to_pylist() for c in batch.columns))
            found = itertools.chain.from_iterable(rows(path, content or b"") for path, content in files)
            while part := list(itertools.islice(found, 500)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), to)], schema=to)

    return files.select("path", "content").mapInArrow(run, StructType.fromDDL(schema))


def track_table(files: DataFrame) -> DataFrame:
    """files: path, content (as binaryFile reads them).  One row per track."""
    return _rows_of(files, TRACKS, lambda path, data: [(path, k, t["handler"], t["codec"], t["timescale"], t["width"], t["height"]) for k, t in tracks(data).items()])


def sample_table(files: DataFrame) -> DataFrame:
    """files: path, content, each an init segment with its media or a whole file.  One row per sample; a file is one task's work."""

    def rows(path, data):
        of = tracks(data)
        for track, i, dts, pts, duration, key, x in demux(data):
            own = of.get(track, {})
            yield path, track, i, dts, pts, duration, key, own.get("timescale"), own.get("codec"), x

    return _rows_of(files, SAMPLES, rows)


def remux(samples: DataFrame, per_fragment: int = 30) -> DataFrame:
    """samples: as sample_table gives them, of one track each path.  Fragments of so many samples: path, sequence (from 1), dts, n, content.

    Samples go in order of dts; each lasts to the next one, the last as long as it says.
    """

    class Fragments:
        def __init__(self, path):
            self.path, self.held, self.sequence = path, [], 0

        def out(self, part):
            self.sequence += 1
            first = part[0]
            content = fragment(self.sequence, [(first[0], first[1], [(x, d, key) for _, _, d, key, x in part])])
            return [(self.path, self.sequence, first[1], len(part), content)]

        def row(self, track, dts, duration, key, data):
            if self.held:
                before = self.held[-1]
                self.held[-1] = (*before[:2], dts - before[1], *before[3:])
            self.held.append((track, dts, duration, key, data))
            if len(self.held) <= per_fragment:
                return []
            part, self.held = self.held[:-1], self.held[-1:]
            return self.out(part)

        def end(self):
            return self.out(self.held) if self.held else []

    return folded(samples, "path", ["dts", "index"], ["track", "dts", "duration", "key", "data"], Fragments, "path string, sequence int, dts long, n int, content binary")


def sniffed(files: DataFrame) -> DataFrame:
    """Adds begins_media (content begins with an ftyp or moov box) and begins_file (with an ftyp box); false for null and short content."""
    kind = F.decode(F.substring(F.col("content").cast("binary"), 5, 4), "iso-8859-1")
    return files.withColumn("begins_media", F.coalesce(kind.isin("ftyp", "moov"), F.lit(False))).withColumn("begins_file", F.coalesce(kind == "ftyp", F.lit(False)))


def decode_times(files: DataFrame) -> DataFrame:
    """path and time: the base decode time of a segment's only track fragment, or null."""
    return _rows_of(files, "path string, time long", lambda path, data: [(path, decode_time(data))])


def or_free(content: Column) -> Column:
    """Content, or an empty box where nothing came."""
    return F.coalesce(content, F.lit(bytearray(FREE)))


def init_segments(tracks: DataFrame) -> DataFrame:
    """tracks: path, width, height, scale, rate and channels (null: no sound), record and config (the decoders' own bytes).  path, content.

    Rows are dealt over tasks; a task makes the segments of equal settings once, of the latest 1,024 settings.
    """
    ship(tracks.sparkSession)
    to = to_arrow_schema(StructType.fromDDL("path string, content binary"))

    def run(batches):
        made = functools.lru_cache(1024)(init_segment)
        for batch in batches:
            out = [
                (path, made(width, height, scale, record or b"", (rate, channels, config or b"") if rate else None))
                for path, width, height, scale, rate, channels, record, config in zip(*(c.to_pylist() for c in batch.columns))
            ]
            cols = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, to)], schema=to)

    return spread(tracks.select("path", "width", "height", "scale", "rate", "channels", "record", "config")).mapInArrow(run, "path string, content binary")


def media_segments(samples: DataFrame) -> DataFrame:
    """samples: path, sequence (the segment's number in it), track, index, dts, duration, key, data.  One fragment for each path and sequence: path, sequence, content.

    A segment's tracks stand one after another in it, in order of their numbers, each from its first sample's dts on.  A task holds a segment.
    """

    class Segment:
        def __init__(self, at):
            self.at, self.tracks = at, {}

        def row(self, track, dts, duration, key, data):
            self.tracks.setdefault(track, (track, dts, []))[2].append((data, duration, key))
            return []

        def end(self):
            return [(self.at["path"], self.at["sequence"], fragment(self.at["sequence"], list(self.tracks.values())))]

    rows = samples.select(F.struct("path", "sequence").alias("at"), "track", "index", "dts", "duration", "key", "data")
    return folded(rows, "at", ["track", "index"], ["track", "dts", "duration", "key", "data"], Segment, "path string, sequence int, content binary")


def audio_config(esds: bytes) -> bytes | None:
    """The decoder-specific bytes inside an elementary stream descriptor's content."""

    def walk(at: int, end: int) -> bytes | None:
        while at + 2 <= end:
            tag, at, n = esds[at], at + 1, 0
            for _ in range(4):
                c, at = esds[at], at + 1
                n = n << 7 | c & 127
                if not c & 128:
                    break
            stop = min(at + n, end)
            if tag == 5:
                return esds[at:stop]
            skip = {3: 3, 4: 13}.get(tag)
            if skip is not None and (found := walk(at + skip, stop)) is not None:
                return found
            at = stop
        return None

    return walk(0, len(esds))


def parameter_sets(data: bytes) -> list[tuple[int, bytes]]:
    """(type, unit) of the parameter sets in the first decoder configuration record found."""
    at = data.find(b"hvcC")
    if at < 0:
        return []
    at += 4 + 22
    out = []
    if at >= len(data):
        return out
    arrays, at = data[at], at + 1
    for _ in range(arrays):
        if at + 3 > len(data):
            break
        kind, n, at = data[at] & 63, int.from_bytes(data[at + 1 : at + 3], "big"), at + 3
        for _ in range(n):
            size, at = int.from_bytes(data[at : at + 2], "big"), at + 2
            if at + size > len(data):
                return out
            out.append((kind, data[at : at + size]))
            at += size
    return out


FREE = box(b"free")  # what stands for a segment of which nothing came


def _track(track: int, scale: int, handler: bytes, header: bytes, entry: bytes, width: int = 0, height: int = 0) -> bytes:
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    volume = 0x0100 if handler == b"soun" else 0
    tkhd = full_box(b"tkhd", 0, 3, struct.pack(">5I", 0, 0, track, 0, 0), b"\0" * 8, struct.pack(">4H", 0, 0, volume, 0), matrix, struct.pack(">II", width << 16, height << 16))
    mdhd = full_box(b"mdhd", 0, 0, struct.pack(">4I2H", 0, 0, scale, 0, 0x55C4, 0))
    hdlr = full_box(b"hdlr", 0, 0, b"\0" * 4 + handler + b"\0" * 12 + b"handler\0")
    dinf = box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), full_box(b"url ", 0, 1)))
    empty = [full_box(k, 0, 0, b"\0" * n) for k, n in ((b"stts", 4), (b"stsc", 4), (b"stsz", 8), (b"stco", 4))]
    stbl = box(b"stbl", full_box(b"stsd", 0, 0, struct.pack(">I", 1), entry), *empty)
    return box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", header, dinf, stbl)))


def init_segment(width: int, height: int, scale: int, avcc: bytes, audio: tuple[int, int, bytes] | None = None) -> bytes:
    """ftyp and moov for an AVC track 1 and, given (sample rate, channels, decoder-specific bytes), an AAC track 2."""
    entry = box(
        b"avc1", b"\0" * 6 + struct.pack(">H", 1) + b"\0" * 16 + struct.pack(">HHII", width, height, 0x480000, 0x480000) + b"\0" * 4
        + struct.pack(">H", 1) + b"\0" * 32 + struct.pack(">Hh", 24, -1), box(b"avcC", avcc),
    )
    tracks = [_track(1, scale, b"vide", full_box(b"vmhd", 0, 1, b"\0" * 8), entry, width, height)]
    if audio:
        rate, channels, specific = audio
        esds = full_box(b"esds", 0, 0, descriptor(3, struct.pack(">HB", 0, 0) + descriptor(4, b"\x40\x15" + b"\0" * 11 + descriptor(5, specific)) + descriptor(6, b"\2")))
        sound = box(b"mp4a", b"\0" * 6 + struct.pack(">H", 1) + b"\0" * 8 + struct.pack(">HHHHI", channels, 16, 0, 0, rate << 16), esds)
        tracks.append(_track(2, rate, b"soun", full_box(b"smhd", 0, 0, b"\0" * 4), sound))
    mvhd = full_box(b"mvhd", 0, 0, struct.pack(">6I", 0, 0, scale, 0, 0x10000, 0x01000000), b"\0" * 8, struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000), b"\0" * 24, struct.pack(">I", len(tracks) + 1))
    extends = box(b"mvex", *(full_box(b"trex", 0, 0, struct.pack(">5I", k + 1, 1, 0, 0, 0)) for k in range(len(tracks))))
    return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2avc1mp41") + box(b"moov", mvhd, *tracks, extends)
