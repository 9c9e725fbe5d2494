"""Slices of streams of units, each read with the parameter sets that were written last before it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..common import folded
from ..functions.syntax import Bits, Pps, Sps, parse_pps, parse_slice_header, parse_sps

#: What a stream that breaks the rules may run into; it is then given as a problem.
BROKEN = (ValueError, IndexError, KeyError)


class Slices:
    """One stream's units in order: the parameter sets so far, and a row for each slice."""

    def __init__(self, stream):
        self.stream = stream
        self.sps: dict[int, Sps] = {}
        self.pps: dict[int, Pps] = {}

    def row(self, at, kind, rbsp):
        data = bytes(rbsp or b"")
        try:
            if kind == 33:
                s = parse_sps(data)
                self.sps[s.sps_id] = s
            elif kind == 34:
                p = parse_pps(data)
                if p.sps_id in self.sps:  # one whose sequence parameter set isn't there yet is rejected
                    self.pps[p.pps_id] = p
        except BROKEN:
            pass  # dump_headers tells what is wrong with it
        return [self.slice(at, kind, data)] if kind <= 9 or 16 <= kind <= 21 else []

    def slice(self, at, kind, data):
        try:
            b = Bits(data)
            b.u(2 if 16 <= kind <= 23 else 1)
            pps = self.pps.get(b.ue())
            sps = self.sps.get(pps.sps_id) if pps else None
            if not sps:
                raise ValueError("a slice refers to no parameter set")
            h = parse_slice_header(data, kind, pps, sps)
        except BROKEN as e:
            return self.stream, at, None, None, None, None, None, None, str(e)
        kind_of = None if h.slice_type is None else "BPI"[h.slice_type]
        return self.stream, at, h.first, h.address, kind_of, None if h.dependent else h.qp, h.poc_lsb, str(h), None

    def end(self):
        return []


def dump_slices(units: DataFrame, stream: str = "stream", order: str = "nal_idx") -> DataFrame:
    """One row per slice: stream, order, first, address, slice_type (I, P or B; null in a dependent segment), qp, poc_lsb, all of its header as
    text, or what is wrong with it.  Each is read with the parameter sets that were written last before it."""
    kinds = dict(units.dtypes)
    schema = f"`{stream}` {kinds[stream]}, `{order}` {kinds[order]}, first boolean, address int, slice_type string, qp int, poc_lsb int, text string, problem string"
    return folded(units, stream, [order], [order, "type", "rbsp"], Slices, schema)
