"""Parsing parameter sets and slice headers, bit by bit, as the H.265 standard lays them out.

Every parser raises ValueError for values outside what the standard allows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..common import ship


class Bits:
    """A cursor over a payload's bits."""

    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def u(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the payload ends too early")
        self.at += n
        return self.value >> (self.size - self.at) & ((1 << n) - 1)

    def flag(self) -> bool:
        return bool(self.u(1))

    def signed(self, n: int) -> int:
        x = self.u(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 32:
                raise ValueError("a code of over 32 zeros")
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)

    def aligned(self) -> bool:
        return self.at % 8 == 0

    def more_data(self) -> bool:
        """Whether anything stands before the closing one bit."""
        rest = self.value & ((1 << (self.size - self.at)) - 1)
        return rest != 0 and rest.bit_count() > 1


class Writer:
    """The other way round; for tests and for building streams."""

    def __init__(self):
        self.text = ""

    def u(self, x: int, n: int) -> Writer:
        self.text += format(x, f"0{n}b") if n else ""
        return self

    def ue(self, x: int) -> Writer:
        b = format(x + 1, "b")
        self.text += "0" * (len(b) - 1) + b
        return self

    def se(self, x: int) -> Writer:
        return self.ue(2 * x - 1 if x > 0 else -2 * x)

    def done(self) -> bytes:
        t = self.text + "1"
        t += "0" * (-len(t) % 8)
        return int(t, 2).to_bytes(len(t) // 8, "big")


@dataclass
class ProfileTierLevel:
    profile: int = 0
    tier: int = 0
    level: int = 0


def profile_tier_level(b: Bits, sub_layers: int) -> ProfileTierLevel:
    b.u(2)
    out = ProfileTierLevel(tier=b.u(1), profile=b.u(5))
    b.u(32), b.u(48)
    out.level = b.u(8)
    there = [(b.flag(), b.flag()) for _ in range(sub_layers - 1)]
    if sub_layers > 1:
        b.u(2 * (8 - (sub_layers - 1)))
    for profile, level in there:
        b.u(88 * profile + 8 * level)
    return out


@dataclass
class Vps:
    vps_id: int
    layers: int
    sub_layers: int
    nesting: bool
    profile: int
    tier: int
    level: int
    max_dpb: int
    max_reorder: int
    timing: tuple[int, int] | None  # units in a tick, ticks in a second


def _sub_layer_sizes(b: Bits, sub_layers: int) -> tuple[int, int]:
    """Pictures held and reordered at most, of the highest sub-layer."""
    dpb = reorder = 0
    for _ in range(sub_layers if b.flag() else 1):
        dpb, reorder, _ = b.ue() + 1, b.ue(), b.ue()
    if dpb > 16 or reorder >= dpb:
        raise ValueError("picture buffer out of range")
    return dpb, reorder


def parse_vps(data: bytes) -> Vps:
    b = Bits(data)
    vps = b.u(4)
    b.u(2)
    layers, sub, nesting = b.u(6) + 1, b.u(3) + 1, b.flag()
    if b.u(16) != 0xFFFF or sub > 7:
        raise ValueError("reserved bits or sub-layers out of range")
    ptl = profile_tier_level(b, sub)
    dpb, reorder = _sub_layer_sizes(b, sub)
    last, sets = b.u(6), b.ue() + 1
    if sets > 1024:
        raise ValueError("too many layer sets")
    b.u((sets - 1) * (last + 1))
    timing = (b.u(32), b.u(32)) if b.flag() else None
    return Vps(vps, layers, sub, nesting, ptl.profile, ptl.tier, ptl.level, dpb, reorder, timing)


# -- scaling lists

# The default 8 x 8 lists of intra and inter blocks, in the order in which they are coded.
INTRA_LIST = (
    16, 16, 16, 16, 16, 16, 16, 16, 16, 16, 17, 16, 17, 16, 17, 18, 17, 18, 18, 17, 18, 21, 19, 20, 21, 20, 19, 21, 24, 22, 22, 24,
    24, 22, 22, 24, 25, 25, 27, 30, 27, 25, 25, 29, 31, 35, 35, 31, 29, 36, 41, 44, 41, 36, 47, 54, 54, 47, 65, 70, 65, 88, 88, 115,
)
INTER_LIST = (
    16, 16, 16, 16, 16, 16, 16, 16, 16, 16, 17, 17, 17, 17, 17, 18, 18, 18, 18, 18, 18, 20, 20, 20, 20, 20, 20, 20, 24, 24, 24, 24,
    24, 24, 24, 24, 25, 25, 25, 25, 25, 25, 25, 28, 28, 28, 28, 28, 28, 33, 33, 33, 33, 33, 41, 41, 41, 41, 54, 54, 54, 71, 71, 91,
)


@dataclass
class Scaling:
    """For each size (4, 8, 16, 32) and matrix (three intra, three inter): a list in coded order, and its DC value."""

    lists: list[list[list[int]]]
    dc: list[list[int]]

    @classmethod
    def default(cls) -> Scaling:
        own = lambda size, m: [16] * 16 if size == 0 else list(INTRA_LIST if m < 3 else INTER_LIST)
        return cls([[own(s, m) for m in range(6)] for s in range(4)], [[16] * 6 for _ in range(4)])


def scaling_lists(b: Bits) -> Scaling:
    """Coded lists; each is given outright, or a copy of an earlier one of its size or of the default."""
    out, plain = Scaling.default(), Scaling.default()
    for size in range(4):
        step = 3 if size == 3 else 1
        for m in range(0, 6, step):
            if not b.flag():
                back = b.ue() * step
                if back > m:
                    raise ValueError("a scaling list refers to none")
                out.lists[size][m] = list(out.lists[size][m - back] if back else plain.lists[size][m])
                out.dc[size][m] = out.dc[size][m - back] if back else 16
                continue
            n, last = min(64, 16 << (2 * size)), 8
            if size > 1:
                last = out.dc[size][m] = b.se() + 8
            values = []
            for _ in range(n):
                last = (last + b.se()) % 256
                values.append(last)
            out.lists[size][m] = values
    return out


# -- reference picture sets


@dataclass
class RefSet:
    """POC distances of pictures to keep, each with whether the current one may use it: nearest first, earlier and later ones."""

    before: list[tuple[int, bool]]
    after: list[tuple[int, bool]]

    def __len__(self) -> int:
        return len(self.before) + len(self.after)


def ref_set(b: Bits, at: int, sets: list[RefSet], n_sets: int, most: int) -> RefSet:
    """The at-th set, given outright or by what changes against an earlier one (at == n_sets: in a slice header)."""
    if at and b.flag():
        back = b.ue() + 1 if at == n_sets else 1
        if back > at:
            raise ValueError("a reference set refers to none")
        negative, size = b.flag(), b.ue() + 1
        shift, of = -size if negative else size, sets[at - back]
        marks = []
        for _ in range(len(of) + 1):
            used = b.flag()
            marks.append((used, used or b.flag()))
        # the distances of the other set's pictures from this one, and that of the other set's own picture
        distances = [d for d, _ in of.before] + [d for d, _ in of.after] + [0]
        kept = [(d + shift, used) for d, (used, keep) in zip(distances, marks) if keep and d + shift]
        out = RefSet(sorted((x for x in kept if x[0] < 0), key=lambda x: -x[0]), sorted((x for x in kept if x[0] > 0), key=lambda x: x[0]))
    else:
        n_before, n_after = b.ue(), b.ue()
        if n_before > most or n_after > most - n_before:
            raise ValueError("too many reference pictures")
        out = RefSet([], [])
        for group, sign, n in ((out.before, -1, n_before), (out.after, 1, n_after)):
            d = 0
            for _ in range(n):
                d += sign * (b.ue() + 1)
                group.append((d, b.flag()))
    if len(out) > most:
        raise ValueError("too many reference pictures")
    return out


def _hrd(b: Bits, common: bool, sub_layers: int) -> None:
    """Buffer models are read past."""
    nal = vcl = sub = False
    if common:
        nal, vcl = b.flag(), b.flag()
        if nal or vcl:
            sub = b.flag()
            b.u(19 if sub else 0)
            b.u(8)
            b.u(4 if sub else 0)
            b.u(15)
    for _ in range(sub_layers):
        fixed = b.flag() or b.flag()
        low, n = False, 1
        if fixed:
            b.ue()
        else:
            low = b.flag()
        if not low:
            n = b.ue() + 1
        for _ in range((nal + vcl) * n):
            b.ue(), b.ue()
            if sub:
                b.ue(), b.ue()
            b.u(1)


@dataclass
class Vui:
    aspect: int | None = None
    full_range: bool = False
    colour: tuple[int, int, int] | None = None
    timing: tuple[int, int] | None = None


def vui(b: Bits, sub_layers: int) -> Vui:
    out = Vui()
    if b.flag():
        out.aspect = b.u(8)
        b.u(32 if out.aspect == 255 else 0)
    if b.flag():
        b.u(1)
    if b.flag():
        b.u(3)
        out.full_range = b.flag()
        out.colour = (b.u(8), b.u(8), b.u(8)) if b.flag() else None
    if b.flag():
        b.ue(), b.ue()
    b.u(3)
    if b.flag():
        [b.ue() for _ in range(4)]
    if b.flag():
        out.timing = b.u(32), b.u(32)
        if b.flag():
            b.ue()
        if b.flag():
            _hrd(b, True, sub_layers)
    if b.flag():
        b.u(3)
        [b.ue() for _ in range(5)]
    return out


@dataclass
class Sps:
    sps_id: int
    vps_id: int
    sub_layers: int
    profile: int
    tier: int
    level: int
    chroma: int
    width: int
    height: int
    crop: list[int]  # left, right, top, bottom, in chroma units
    depth_luma: int
    depth_chroma: int
    log2_max_poc_lsb: int
    max_dpb: int
    max_reorder: int
    log2_min_cb: int
    log2_ctb: int
    log2_min_tb: int
    log2_max_tb: int
    depth_inter: int = 0
    depth_intra: int = 0
    scaling: Scaling | None = None
    amp: bool = False
    sao: bool = False
    pcm: tuple[int, int, int, int, bool] | None = None  # bits of luma, bits of chroma, log2 least and largest size, no loop filter
    ref_sets: list[RefSet] = field(default_factory=list)
    long_term: bool = False
    long_term_pocs: list[tuple[int, bool]] = field(default_factory=list)
    temporal_mvp: bool = False
    strong_smoothing: bool = False
    vui: Vui | None = None

    @property
    def shown(self) -> tuple[int, int]:
        """Width and height after cropping."""
        x, y = (2 if self.chroma in (1, 2) else 1), (2 if self.chroma == 1 else 1)
        return self.width - x * (self.crop[0] + self.crop[1]), self.height - y * (self.crop[2] + self.crop[3])

    @property
    def ctbs(self) -> tuple[int, int]:
        side = 1 << self.log2_ctb
        return -(-self.width // side), -(-self.height // side)


def parse_sps(data: bytes) -> Sps:
    b = Bits(data)
    vps, layers = b.u(4), b.u(3) + 1
    b.u(1)
    if layers > 7:
        raise ValueError("too many sub-layers")
    ptl = profile_tier_level(b, layers)
    sps, chroma = b.ue(), b.ue()
    if sps > 15 or chroma > 3:
        raise ValueError("id or chroma format out of range")
    if chroma == 3 and b.u(1):
        raise ValueError("separate colour planes aren't supported")
    width, height = b.ue(), b.ue()
    if not width or not height or width > 16384 or height > 16384:
        raise ValueError("picture size out of range")
    crop = [b.ue() for _ in range(4)] if b.flag() else [0, 0, 0, 0]
    luma, chroma_depth, poc = b.ue() + 8, b.ue() + 8, b.ue() + 4
    if luma > 16 or chroma_depth > 16 or poc > 16:
        raise ValueError("bit depth or counter size out of range")
    dpb, reorder = _sub_layer_sizes(b, layers)
    low, more, tb, tb_more = b.ue() + 3, b.ue(), b.ue() + 2, b.ue()
    if low + more > 6 or low + more < 4 or tb >= low or tb + tb_more > min(low + more, 5):
        raise ValueError("block sizes out of range")
    out = Sps(sps, vps, layers, ptl.profile, ptl.tier, ptl.level, chroma, width, height, crop, luma, chroma_depth, poc, dpb, reorder, low, low + more, tb, tb + tb_more)
    if width % (1 << low) or height % (1 << low) or min(out.shown) <= 0:
        raise ValueError("picture size out of range")
    out.depth_inter, out.depth_intra = b.ue(), b.ue()
    if max(out.depth_inter, out.depth_intra) > low + more - tb:
        raise ValueError("transform depth out of range")
    if b.flag():
        out.scaling = scaling_lists(b) if b.flag() else Scaling.default()
    out.amp, out.sao = b.flag(), b.flag()
    if b.flag():
        own, other, least = b.u(4) + 1, b.u(4) + 1, b.ue() + 3
        largest = least + b.ue()
        if own > luma or other > chroma_depth or least < low or largest > min(low + more, 5):
            raise ValueError("raw blocks out of range")
        out.pcm = own, other, least, largest, b.flag()
    n = b.ue()
    if n > 64:
        raise ValueError("too many reference sets")
    for i in range(n):
        out.ref_sets.append(ref_set(b, i, out.ref_sets, n, 15))
    out.long_term = b.flag()
    if out.long_term:
        n = b.ue()
        if n > 32:
            raise ValueError("too many long-term pictures")
        out.long_term_pocs = [(b.u(poc), b.flag()) for _ in range(n)]
    out.temporal_mvp, out.strong_smoothing = b.flag(), b.flag()
    if b.flag():
        out.vui = vui(b, layers)
    return out


@dataclass
class Pps:
    pps_id: int
    sps_id: int
    dependent_slices: bool
    output_flag: bool
    extra_bits: int
    sign_hiding: bool
    cabac_init: bool
    n_refs: tuple[int, int] = (1, 1)
    init_qp: int = 26
    constrained_intra: bool = False
    transform_skip: bool = False
    cu_qp_delta: bool = False
    qp_delta_depth: int = 0
    cb_qp: int = 0
    cr_qp: int = 0
    slice_chroma_qp: bool = False
    weighted: bool = False
    weighted_bi: bool = False
    bypass: bool = False
    tiles: bool = False
    wavefront: bool = False
    columns: list[int] = field(default_factory=list)  # sizes in coding tree blocks; but for the last if explicit
    rows: list[int] = field(default_factory=list)
    n_tiles: tuple[int, int] = (1, 1)
    uniform: bool = True
    filter_tiles: bool = True
    filter_slices: bool = False
    deblock_override: bool = False
    deblock_off: bool = False
    beta: int = 0
    tc: int = 0
    scaling: Scaling | None = None
    lists_modification: bool = False
    log2_merge_level: int = 2
    header_extension: bool = False

    def tile_starts(self, sps: Sps) -> tuple[list[int], list[int]]:
        """Columns and rows at which tiles start, in coding tree blocks."""
        out = []
        for total, n, sizes in zip(sps.ctbs, self.n_tiles, (self.columns, self.rows)):
            out.append([i * total // n for i in range(n)] if self.uniform else [sum(sizes[:i]) for i in range(n)])
            if out[-1][-1] >= total or n > total:
                raise ValueError("tiles don't fit the picture")
        return out[0], out[1]


def parse_pps(data: bytes) -> Pps:
    b = Bits(data)
    pps, sps = b.ue(), b.ue()
    if pps > 63 or sps > 15:
        raise ValueError("id out of range")
    out = Pps(pps, sps, b.flag(), b.flag(), b.u(3), b.flag(), b.flag())
    out.n_refs = b.ue() + 1, b.ue() + 1
    out.init_qp = 26 + b.se()
    out.constrained_intra, out.transform_skip, out.cu_qp_delta = b.flag(), b.flag(), b.flag()
    out.qp_delta_depth = b.ue() if out.cu_qp_delta else 0
    out.cb_qp, out.cr_qp = b.se(), b.se()
    if max(out.n_refs) > 16 or not -22 <= out.init_qp <= 51 or out.qp_delta_depth > 3 or max(abs(out.cb_qp), abs(out.cr_qp)) > 12:
        raise ValueError("references or quantisation out of range")
    out.slice_chroma_qp, out.weighted, out.weighted_bi, out.bypass, out.tiles, out.wavefront = (b.flag() for _ in range(6))
    if out.tiles:
        out.n_tiles = b.ue() + 1, b.ue() + 1
        if out.n_tiles[0] > 20 or out.n_tiles[1] > 22:
            raise ValueError("too many tiles")
        out.uniform = b.flag()
        if not out.uniform:
            out.columns, out.rows = ([b.ue() + 1 for _ in range(n - 1)] for n in out.n_tiles)
        out.filter_tiles = b.flag()
    out.filter_slices = b.flag()
    if b.flag():
        out.deblock_override, out.deblock_off = b.flag(), b.flag()
        if not out.deblock_off:
            out.beta, out.tc = 2 * b.se(), 2 * b.se()
            if max(abs(out.beta), abs(out.tc)) > 12:
                raise ValueError("filter offsets out of range")
    if b.flag():
        out.scaling = scaling_lists(b)
    out.lists_modification = b.flag()
    out.log2_merge_level = b.ue() + 2
    out.header_extension = b.flag()
    return out


@dataclass
class Weights:
    """Of each list's pictures: for luma and both chromas a weight and an offset."""

    log2_luma: int
    log2_chroma: int
    lists: list[list[list[tuple[int, int]]]]


def weight_table(b: Bits, sps: Sps, sizes: list[int]) -> Weights:
    luma = b.ue()
    chroma = luma + b.se() if sps.chroma else 0
    if luma > 7 or not 0 <= chroma <= 7:
        raise ValueError("weights out of range")
    lists = []
    for n in sizes:
        own = [b.flag() for _ in range(n)]
        other = [b.flag() for _ in range(n)] if sps.chroma else [False] * n
        rows = []
        for i in range(n):
            row = [(1 << luma, 0), (1 << chroma, 0), (1 << chroma, 0)]
            if own[i]:
                row[0] = (1 << luma) + b.se(), b.se()
            for k in (1, 2) if other[i] else ():
                w = (1 << chroma) + b.se()
                row[k] = w, max(-128, min(127, 128 + b.se() - (128 * w >> chroma)))
            rows.append(row)
        lists.append(rows)
    return Weights(luma, chroma, lists)


@dataclass
class SliceHeader:
    first: bool
    pps_id: int
    dependent: bool
    address: int
    slice_type: int | None = None  # 0 B, 1 P, 2 I; None in a dependent slice, which inherits what follows
    output: bool = True
    poc_lsb: int | None = None
    ref_set: RefSet | None = None
    long_term: list[tuple[int, bool, int | None]] = field(default_factory=list)  # low bits, may be used, cycles of high bits back
    temporal_mvp: bool = False
    sao_luma: bool = False
    sao_chroma: bool = False
    n_refs: list[int] = field(default_factory=list)
    entries: list[list[int] | None] = field(default_factory=list)
    mvd_l1_zero: bool = False
    cabac_init: bool = False
    collocated: tuple[int, int] = (0, 0)  # list and index
    weights: Weights | None = None
    max_merge: int = 0
    qp: int = 26
    cb_qp: int = 0
    cr_qp: int = 0
    deblock_off: bool = False
    beta: int = 0
    tc: int = 0
    filter_across: bool = False
    entry_points: list[int] = field(default_factory=list)
    data_at: int = 0  # byte at which slice data begins


def parse_slice_header(data: bytes, kind: int, pps: Pps, sps: Sps) -> SliceHeader:
    """The whole header of a slice in a unit of this kind."""
    b = Bits(data)
    first = b.flag()
    if 16 <= kind <= 23:
        b.u(1)
    h = SliceHeader(first, b.ue(), False, 0)
    if not first:
        h.dependent = pps.dependent_slices and b.flag()
        n = sps.ctbs[0] * sps.ctbs[1]
        h.address = b.u((n - 1).bit_length())
        if not 0 < h.address < n:
            raise ValueError("slice address out of range")
    if not h.dependent:
        _slice_fields(b, h, kind, pps, sps)
    if pps.tiles or pps.wavefront:
        n = b.ue()
        if n > sps.ctbs[0] * sps.ctbs[1]:
            raise ValueError("too many entry points")
        size = b.ue() + 1 if n else 0
        if size > 32:
            raise ValueError("entry points out of range")
        h.entry_points = [b.u(size) + 1 for _ in range(n)]
    if pps.header_extension:
        b.u(8 * b.ue())
    if not b.u(1):
        raise ValueError("a slice header doesn't end")
    h.data_at = -(-b.at // 8)
    return h


def _slice_fields(b: Bits, h: SliceHeader, kind: int, pps: Pps, sps: Sps) -> None:
    b.u(pps.extra_bits)
    h.slice_type = b.ue()
    if h.slice_type > 2 or h.slice_type != 2 and 16 <= kind <= 23:
        raise ValueError("slice type out of range")
    if pps.output_flag:
        h.output = b.flag()
    h.poc_lsb, h.ref_set = 0, RefSet([], [])
    if kind not in (19, 20):
        h.poc_lsb = b.u(sps.log2_max_poc_lsb)
        n = len(sps.ref_sets)
        if not b.flag():
            h.ref_set = ref_set(b, n, sps.ref_sets, n, 15)
        else:
            at = b.u((n - 1).bit_length()) if n > 1 else 0
            if at >= n:
                raise ValueError("a slice refers to no reference set")
            h.ref_set = sps.ref_sets[at]
        if sps.long_term:
            _long_term(b, h, sps)
        h.temporal_mvp = sps.temporal_mvp and b.flag()
    if sps.sao:
        h.sao_luma = b.flag()
        h.sao_chroma = bool(sps.chroma) and b.flag()
    if h.slice_type != 2:
        _inter_fields(b, h, pps, sps)
    h.qp = pps.init_qp + b.se()
    if pps.slice_chroma_qp:
        h.cb_qp, h.cr_qp = b.se(), b.se()
    if not -6 * (sps.depth_luma - 8) <= h.qp <= 51 or max(abs(pps.cb_qp + h.cb_qp), abs(pps.cr_qp + h.cr_qp)) > 12:
        raise ValueError("quantisation out of range")
    override = pps.deblock_override and b.flag()
    h.deblock_off, h.beta, h.tc = pps.deblock_off, pps.beta, pps.tc
    if override:
        h.deblock_off = b.flag()
        if not h.deblock_off:
            h.beta, h.tc = 2 * b.se(), 2 * b.se()
            if max(abs(h.beta), abs(h.tc)) > 12:
                raise ValueError("filter offsets out of range")
    h.filter_across = pps.filter_slices
    if pps.filter_slices and (h.sao_luma or h.sao_chroma or not h.deblock_off):
        h.filter_across = b.flag()


def _long_term(b: Bits, h: SliceHeader, sps: Sps) -> None:
    n = len(sps.long_term_pocs)
    from_sps = b.ue() if n else 0
    own = b.ue()
    if from_sps + own + len(h.ref_set) > 16:
        raise ValueError("too many long-term pictures")
    back = 0
    for i in range(from_sps + own):
        if i < from_sps:
            at = b.u((n - 1).bit_length()) if n > 1 else 0
            if at >= n:
                raise ValueError("a slice refers to no long-term picture")
            low, used = sps.long_term_pocs[at]
        else:
            low, used = b.u(sps.log2_max_poc_lsb), b.flag()
        high = b.flag()
        more = b.ue() if high else 0
        back = more if i in (0, from_sps) else back + more  # cycles add up within each kind
        h.long_term.append((low, used, back if high else None))


def _inter_fields(b: Bits, h: SliceHeader, pps: Pps, sps: Sps) -> None:
    two = h.slice_type == 0
    h.n_refs = list(pps.n_refs[: 1 + two])
    if b.flag():
        h.n_refs = [b.ue() + 1 for _ in range(1 + two)]
        if max(h.n_refs) > 15:
            raise ValueError("too many references")
    usable = sum(u for _, u in h.ref_set.before + h.ref_set.after) + sum(u for _, u, _ in h.long_term)
    h.entries = [None] * len(h.n_refs)
    if pps.lists_modification and usable > 1:
        for i, n in enumerate(h.n_refs):
            if b.flag():
                h.entries[i] = [b.u((usable - 1).bit_length()) for _ in range(n)]
                if max(h.entries[i]) >= usable:
                    raise ValueError("a reference list refers to no picture")
    h.mvd_l1_zero = two and b.flag()
    h.cabac_init = pps.cabac_init and b.flag()
    if h.temporal_mvp:
        side = 0 if not two or b.flag() else 1
        h.collocated = side, b.ue() if h.n_refs[side] > 1 else 0
        if h.collocated[1] >= h.n_refs[side]:
            raise ValueError("the collocated picture is in no list")
    if pps.weighted and not two or pps.weighted_bi and two:
        h.weights = weight_table(b, sps, h.n_refs)
    h.max_merge = 5 - b.ue()
    if not 1 <= h.max_merge <= 5:
        raise ValueError("merge candidates out of range")


# -- as DataFrames

SPS_FIELDS = "sps_id int, profile int, level int, chroma int, width int, height int, depth_luma int, log2_max_poc_lsb int, max_dpb int, max_reorder int"
HEADER_FIELDS = "id int, refers_to int, text string, problem string"


def parse_parameter_sets(units: DataFrame) -> DataFrame:
    """units (stream, nal_idx, type, rbsp): one row per sequence parameter set, or what is wrong with it."""
    names = [x.split()[0] for x in SPS_FIELDS.split(", ")]

    def parse(_, rbsp):
        s = asdict(parse_sps(rbsp))
        return [s[n] for n in names]

    return _parsed(units.filter("type = 33"), parse, SPS_FIELDS)


def dump_headers(units: DataFrame) -> DataFrame:
    """One row per parameter set: stream, nal_idx, its id and the id it refers to, all that it says as text, or what is wrong with it."""

    def parse(kind, rbsp):
        if kind == 32:
            x = parse_vps(rbsp)
            return [x.vps_id, None, str(x)]
        if kind == 33:
            x = parse_sps(rbsp)
            return [x.sps_id, x.vps_id, str(x)]
        x = parse_pps(rbsp)
        return [x.pps_id, x.sps_id, str(x)]

    return _parsed(units.filter("type in (32, 33, 34)"), parse, HEADER_FIELDS.removesuffix(", problem string"))


def _parsed(units: DataFrame, parse: Callable[[int, bytes], list], fields: str) -> DataFrame:
    ship(units.sparkSession)
    schema = StructType.fromDDL(f"stream string, nal_idx int, {fields}, problem string")
    to = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = []
            for stream, i, kind, rbsp in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    out.append((stream, i, *parse(kind, bytes(rbsp or b"")), None))
                except ValueError as e:
                    out.append((stream, i, *[None] * (len(to) - 3), str(e)))
            cols = list(zip(*out)) or [[]] * len(to)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, to)], schema=to)

    return units.select("stream", "nal_idx", "type", "rbsp").mapInArrow(run, schema)
