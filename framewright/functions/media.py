"""Media metadata as Spark expressions: unit kinds, codec strings, time bases."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .bits import round_half_up


def is_vcl(t: Column) -> Column:
    return t.between(0, 31)


def is_irap(t: Column) -> Column:
    return t.between(16, 23)


def is_idr(t: Column) -> Column:
    return t.isin(19, 20)


def is_bla(t: Column) -> Column:
    return t.between(16, 18)


def is_cra(t: Column) -> Column:
    return t == 21


def is_rasl(t: Column) -> Column:
    return t.isin(8, 9)


def is_radl(t: Column) -> Column:
    return t.isin(6, 7)


def codec_for_level(codec: Column) -> Column:
    """The H.264 codec string that stands in for an H.265 one such as hvc1.1.6.L120.90."""
    level = F.try_to_number(F.nullif(F.regexp_extract(codec, r"\.[LH](\d+)", 1), F.lit("")), F.lit("99999")).cast("int")
    return F.when(level.isNull() | (level >= 150), "avc1.640033").when(level >= 120, "avc1.64002a").otherwise("avc1.640028")


def codec_for_pixels(width: Column, height: Column) -> Column:
    n = width.cast("long") * height
    return F.when(n > 2_073_600, "avc1.640033").when(n > 921_600, "avc1.64002a").otherwise("avc1.640028")


def ticks_to_micros(ticks: Column, timescale: Column) -> Column:
    return round_half_up(ticks / timescale * 1_000_000).cast("long")


def frames_per_second(timescale: Column, duration: Column) -> Column:
    """Null where a frame takes no time."""
    return F.when(duration > 0, timescale / duration)


def kilobits(bandwidth: Column) -> Column:
    """Whole kilobits, rounded up."""
    return F.ceil(bandwidth / 1000)


def reduce_depth(sample: Column, depth: Column) -> Column:
    """A sample of `depth` bits as one of 8."""
    return F.least(F.call_function("shiftright", sample, F.greatest(depth - 8, F.lit(0))), F.lit(255))


def packed_samples(samples: Column, depth: Column) -> Column:
    """Samples as bytes, as a file of planes has them: one for each of up to 8 bits, else two, little-endian; null where a sample is."""
    two = F.transform(samples, lambda x: F.lpad(F.hex(x.cast("long")), 4, "0"))
    one = F.transform(samples, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0"))
    swapped = F.transform(two, lambda x: F.concat(F.substring(x, 3, 2), F.substring(x, 1, 2)))
    text = F.array_join(F.when(depth <= 8, one).otherwise(swapped), "")
    return F.when(~F.exists(samples, lambda x: x.isNull()), F.unhex(text))


def unit_kind(t: Column) -> Column:
    """What a unit's type says of it, as a struct of booleans."""
    kinds = {"vcl": is_vcl, "irap": is_irap, "idr": is_idr, "cra": is_cra, "bla": is_bla, "rasl": is_rasl, "radl": is_radl}
    return F.struct(*(f(t).alias(k) for k, f in kinds.items()))


def crop_window(width: Column, height: Column, chroma: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """The part of a picture that is shown: x, y, width, height.  The crop is in chroma samples of the format (0 to 3)."""
    x, y = F.when(chroma.isin(1, 2), 2).otherwise(1), F.when(chroma == 1, 2).otherwise(1)
    return F.struct((left * x).alias("x"), (top * y).alias("y"), (width - (left + right) * x).alias("width"), (height - (top + bottom) * y).alias("height"))


def to_rgb(y: Column, u: Column, v: Column) -> Column:
    """BT.709 red, green and blue; all in 0 to 1, u and v centred on a half."""
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    u, v = u - 0.5, v - 0.5
    return F.struct(held(y + 1.5748 * v).alias("r"), held(y - 0.1873 * u - 0.4681 * v).alias("g"), held(y + 1.8556 * u).alias("b"))


# Levels of messages, from the least telling to none at all.
LEVELS = ("debug", "info", "warn", "error", "silent")


def told(level: Column, threshold: str) -> Column:
    """Whether a message of this level is shown at the threshold; `silent` shows nothing, and an unknown level isn't shown."""
    return level.isin(*LEVELS[LEVELS.index(threshold) : -1])


def fetched(values: Column, index: Column) -> Column:
    """(value, error): the value at an index from 0, or that it is out of range; never a failure."""
    ok = (index >= 0) & (index < F.size(values))
    return F.struct(F.when(ok, F.try_element_at(values, (index + 1).cast("int"))).alias("value"), F.coalesce(~ok, F.lit(True)).alias("error"))
