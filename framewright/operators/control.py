"""A controller that caps a ladder of variants by measured speed, with hysteresis."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..common import folded


@dataclass(frozen=True)
class Settings:
    target: float = 1.3
    raise_after: int = 6
    lower_after: int = 1
    window: int = 2

    def __post_init__(self):
        if self.target <= 1.0:
            raise ValueError("target must be above 1")
        if min(self.window, self.raise_after, self.lower_after) < 1:
            raise ValueError("window, raise_after and lower_after must be 1 at least")


@dataclass
class Controller:
    """Speeds below 1 lower the cap, speeds above the target raise it again, never above the ladder."""

    settings: Settings = Settings()
    ladder: int = 0
    cap: int | None = None
    low: int = 0
    high: int = 0
    speeds: list[float] = field(default_factory=list)
    before: tuple | None = None

    def resize(self, ladder: int) -> None:
        if ladder < 1:
            raise ValueError("a ladder has one rung at least")
        self.ladder = ladder
        if self.cap is not None:
            self.cap = min(self.cap, ladder - 1)

    def observe(self, speed: float, current: int) -> tuple[int | None, float, str]:
        """(cap, mean speed, one of init, hold, lower and raise)."""
        s = self.settings
        if not self.ladder:
            return self.cap, speed, "init"
        self.speeds = [*self.speeds, speed][-s.window :]
        mean = sum(self.speeds) / len(self.speeds)
        if len(self.speeds) < s.window:
            return self.cap, mean, "init"
        slow, fast = mean < 1.0, mean > s.target
        self.low = self.low + 1 if slow else 0
        self.high = self.high + 1 if fast else 0
        to = None
        if slow and self.low >= s.lower_after:
            base = self.cap if self.cap is not None else min(max(current, 0), self.ladder - 1)
            to, reason = (base - 1, "lower") if base > 0 else (None, "")
            self.low = self.low if to is not None else 0
        elif fast and self.high >= s.raise_after:
            to, reason = (self.cap + 1, "raise") if self.cap is not None and self.cap < self.ladder - 1 else (None, "")
            self.high = self.high if to is not None else 0
        if to is None:
            return self.cap, mean, "hold"
        self.before = (self.cap, list(self.speeds), self.low, self.high)
        self.cap, self.speeds, self.low, self.high = to, [], 0, 0
        return to, mean, reason

    def revert(self) -> None:
        """Takes the last change back, once."""
        if self.before:
            self.cap, self.speeds, self.low, self.high = self.before
            self.before = None

    def reset(self) -> None:
        self.cap, self.speeds, self.low, self.high, self.before = None, [], 0, 0, None


def decide(df: DataFrame, key: str, order: list[str], speed: str, ladder: int, start: int, settings: Settings = Settings()) -> DataFrame:
    """One row per row of df: key, order, cap, mean_speed, reason.

    An ordered fold: a task holds one session's few numbers, never its rows.  Sessions of null key are one session; a null
    speed decides nothing: its row has the cap as it is and no mean.
    """
    kinds = dict(df.dtypes)
    names = [key, *order]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", cap int, mean_speed double, reason string"

    class Session:
        def __init__(self, k):
            self.key, self.of = k, Controller(settings)
            self.of.resize(ladder)

        def row(self, *values):
            *at, x = values
            return [(self.key, *at, *((self.of.cap, None, "hold") if x is None else self.of.observe(x, start)))]

        def end(self):
            return []

    return folded(df, key, order, [*order, speed], Session, schema)


def decide_sql(df: DataFrame, key: str, order: list[str], speed: str, ladder: int, start: int, settings: Settings = Settings()) -> DataFrame:
    """The same as one SQL fold over each session's array, null keys and null speeds included; for sessions that fit in a row."""
    s = settings
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(speed).cast("double").alias("x")))).alias("r"))
    zero = "named_struct('cap', cast(null as int), 'low', 0, 'high', 0, 'w', cast(array() as array<double>), 'out', cast(array() as array<struct<cap:int,mean_speed:double,reason:string>>))"
    step = f"""
    (a, e) -> if(e.x is null, named_struct('cap', a.cap, 'low', a.low, 'high', a.high, 'w', a.w, 'out', concat(a.out, array(named_struct('cap', a.cap, 'mean_speed', cast(null as double), 'reason', 'hold')))), transform(array(slice(concat(a.w, array(e.x)), -least(size(a.w) + 1, {s.window}), {s.window})), w ->
      transform(array(aggregate(w, 0D, (p, q) -> p + q) / size(w)), m ->
        transform(array(named_struct('slow', size(w) = {s.window} and m < 1, 'fast', size(w) = {s.window} and m > {s.target}D, 'full', size(w) = {s.window})), f ->
          transform(array(named_struct(
            'lower', f.slow and a.low + 1 >= {s.lower_after} and coalesce(a.cap, {min(max(start, 0), ladder - 1)}) > 0,
            'raise', f.fast and a.high + 1 >= {s.raise_after} and a.cap is not null and a.cap < {ladder - 1})), c ->
            named_struct(
              'cap', case when c.lower then coalesce(a.cap, {min(max(start, 0), ladder - 1)}) - 1 when c.raise then a.cap + 1 else a.cap end,
              'low', case when not f.full then a.low when c.lower or c.raise or not f.slow or a.low + 1 >= {s.lower_after} then 0 else a.low + 1 end,
              'high', case when not f.full then a.high when c.lower or c.raise or not f.fast or a.high + 1 >= {s.raise_after} then 0 else a.high + 1 end,
              'w', if(c.lower or c.raise, cast(array() as array<double>), w),
              'out', concat(a.out, array(named_struct(
                'cap', case when c.lower then coalesce(a.cap, {min(max(start, 0), ladder - 1)}) - 1 when c.raise then a.cap + 1 else a.cap end,
                'mean_speed', m, 'reason', case when not f.full then 'init' when c.lower then 'lower' when c.raise then 'raise' else 'hold' end)))))[0])[0])[0])[0])
    """
    folded = rows.select(key, "r", F.expr(f"aggregate(r, {zero}, {step}).out").alias("o"))
    return folded.select(key, F.explode(F.arrays_zip("r", "o")).alias("z")).select(key, *[F.col(f"z.r.{c}").alias(c) for c in order], "z.o.*")
