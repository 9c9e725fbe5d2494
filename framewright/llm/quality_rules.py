"""Quality rules: a decision list learned from labelled documents' statistics, as ordered Spark conditions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import keep, place, share, table, unused

WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
FIT_ROWS = 20_000  # labelled documents that the list is learned from, in expectation
CUTS = 63  # thresholds that are tried for each statistic: quantiles of what it is learned from
MAX_RULES, MAX_CONDITIONS = 16, 4
PRIOR = 2  # how many documents the share among all is worth in an estimate
PRECISION, LEAST = 0.95, 3  # what a rule must reach among the labelled documents it is the first to cover, and how many of low quality these must be

STATISTICS = (
    "n_words", "chars_per_word", "symbols_per_word", "marks_per_word", "digits_per_char", "capital_words", "distinct_words", "repeated_words", "repeated_lines", "words_per_line",
)


def _long(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)


def _window(words: Column, i: Column) -> Column:
    return F.struct(*(F.get(words, i + k).alias(f"w{k}") for k in range(3)))


def _place_bits(words: Column) -> Column:
    """How many low bits the numbers of an array's windows need."""
    return F.length(F.bin(F.size(words).cast("long")))


def _starts(words: Column, bits: Column) -> Column:
    """The places, in order, of the windows of three words that stand in an array of words more than once.  bits: _place_bits.

    A window's hash and its place are packed into one long, so that a plain sort brings equal ones together.  Those next to one of
    their hash are compared with it word by word.
    """
    n = F.size(words) - 2
    hashed = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(3)))
    high = lambda h: F.call_function("shiftleft", F.call_function("shiftright", h, bits), bits)
    packed = F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: high(hashed(i)).bitwiseOR(i.cast("long"))))
    near = lambda x, y: F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0
    place = lambda x: x.bitwiseXOR(high(x)).cast("int")
    beside = lambda p: F.filter(p, lambda x, j: near(x, F.get(p, j - 1)) | near(x, F.get(p, j + 1)))

    def compared(p: Column) -> Column:
        """How each entry is to the one before: 0 of another hash, 1 the same words, 2 other words of the same hash."""
        same = lambda x, y: _window(words, place(x)) == _window(words, place(y))
        return F.transform(p, lambda x, j: F.when(near(x, F.get(p, j - 1)), F.when(same(x, F.get(p, j - 1)), 1).otherwise(2)).otherwise(0))

    def found(x: Column) -> Column:
        p, to = x["p"], x["to"]
        again = F.transform(p, lambda v, j: F.when((F.get(to, j) == 1) | (F.coalesce(F.get(to, j + 1), F.lit(0)) == 1), place(v)))
        return F.when(F.array_contains(to, 2), _starts_of_mixed(words)).otherwise(F.sort_array(F.filter(again, lambda i: i.isNotNull())))

    some = F.transform(F.array(packed), beside)
    both = F.transform(some, lambda p: F.struct(p.alias("p"), compared(p).alias("to")))
    return F.when(n > 1, F.transform(both, found)[0])


def _starts_of_mixed(words: Column) -> Column:
    """_starts for the few texts in which different windows have the same hash: the windows themselves are sorted."""
    w = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(_window(words, i).alias("w"), i.alias("i"))))
    same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    again = lambda s: F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["i"]))
    return F.sort_array(F.filter(F.transform(F.array(w), again)[0], lambda i: i.isNotNull()))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: Sequence[str] = ()) -> DataFrame:
    """doc_id, others, and counts of each whole text (null: empty), all as longs.

    n_words, word_chars, n_symbols, n_dup_lines (lines with a word, equal to an earlier one), n_repeat_words (words in windows of three that
    stand in the text twice or more), n_lines (with a word), n_marks (! and ?), n_digits, n_capital_words and n_distinct_words.  A row needs nothing of
    any other: no shuffle.
    """
    text, words = F.col("text"), F.col("words")
    bits, = unused(others, "bits")
    d = docs.select(F.col(id_col).alias("doc_id"), *others, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.select(
        "doc_id", *others, F.filter(F.split(text, f"{WHITE}+", -1), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace(text, "[^#*$%&|<>!?0-9]+", "").alias("signs"),
    )
    signs = lambda chars: F.length("signs") - F.length(F.translate("signs", chars, ""))
    capital = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    step = lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + 3 - F.greatest(acc["end"] - i, F.lit(0))).alias("n"))
    covered = F.aggregate(_starts(words, F.col(bits)), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    return d.withColumn(bits, _place_bits(words)).select(
        "doc_id", *others, _long(F.size(words), "n_words"), F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        _long(signs(SYMBOLS), "n_symbols"), _long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"), _long(F.size("lines"), "n_lines"),
        _long(signs("!?"), "n_marks"), _long(signs("0123456789"), "n_digits"), _long(F.size(F.filter(words, capital)), "n_capital_words"),
        _long(F.size(F.array_distinct(words)), "n_distinct_words"), _long(F.coalesce(covered, F.lit(0)), "n_repeat_words"),
    )


def statistics(counts: DataFrame) -> DataFrame:
    """Adds STATISTICS, as doubles; null where there is nothing to divide by."""
    c = {k: F.col(k).cast("double") for k in counts.columns if k.startswith("n_") or k == "word_chars"}
    of = lambda a, b: F.try_divide(c[a], c[b])
    return counts.select(
        "*", of("word_chars", "n_words").alias("chars_per_word"), of("n_symbols", "n_words").alias("symbols_per_word"), of("n_marks", "n_words").alias("marks_per_word"),
        of("n_digits", "word_chars").alias("digits_per_char"), of("n_capital_words", "n_words").alias("capital_words"), of("n_distinct_words", "n_words").alias("distinct_words"),
        of("n_repeat_words", "n_words").alias("repeated_words"), of("n_dup_lines", "n_lines").alias("repeated_lines"), of("n_words", "n_lines").alias("words_per_line"),
    )


@dataclass(frozen=True)
class Condition:
    statistic: int
    above: bool
    cut: int  # the number of the threshold

    def binned(self) -> Column:
        b = F.col("bins")[self.statistic]
        return b > self.cut if self.above else b <= self.cut

    def plain(self, cuts: Sequence[Sequence[float]]) -> tuple[str, str, float]:
        return STATISTICS[self.statistic], ">" if self.above else "<=", cuts[self.statistic][self.cut]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, > or <=, threshold), and how many labelled documents of low and of good quality it was the first to cover."""

    conditions: tuple[tuple[str, str, float], ...]
    low: int
    good: int

    def holds(self) -> Column:
        out = F.lit(True)
        for name, sign, t in self.conditions:
            c = F.col(name).cast("double")
            out = out & (c > F.lit(t) if sign == ">" else c <= F.lit(t))
        return out

    def text(self) -> str:
        return " and ".join(f"{a} {b} {c:g}" for a, b, c in self.conditions)


def _all(conditions: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c.binned(), F.lit(False))
    return out


def _grown(rows: DataFrame) -> list[Condition]:
    """Adds condition after condition, each the one that raises the share of low quality most (as an m-estimate), until none does.  rows: low, bins."""
    rule: list[Condition] = []
    prior = 0.0
    while len(rule) < MAX_CONDITIONS:
        cells = rows.filter(_all(rule)).select("low", F.posexplode("bins").alias("s", "bin"))
        counts = cells.groupBy("s", "bin").agg(F.count_if("low").alias("p"), F.count_if(~F.col("low")).alias("n")).collect()
        of: dict[int, dict[int | None, tuple[int, int]]] = {}
        for r in counts:
            of.setdefault(r["s"], {})[r["bin"]] = (r["p"], r["n"])
        if not of:
            break
        p0, n0 = (sum(x[i] for x in of[0].values()) for i in (0, 1))
        if not p0 or not n0:
            break
        prior, worth_now = prior or p0 / (p0 + n0), (p0 + PRIOR * (prior or p0 / (p0 + n0))) / (p0 + n0 + PRIOR)
        best: tuple[float, Condition] | None = None
        for s, bins in sorted(of.items()):
            known = sorted(b for b in bins if b is not None)
            p_all, n_all = (sum(bins[b][i] for b in known) for i in (0, 1))
            p = n = 0
            for b in known[:-1]:
                p, n = p + bins[b][0], n + bins[b][1]
                # bin b holds what is above b thresholds: these rows aren't above threshold number b, those of higher bins are
                for above, pc, nc in ((False, p, n), (True, p_all - p, n_all - n)):
                    worth = (pc + PRIOR * prior) / (pc + nc + PRIOR)
                    if pc >= LEAST and worth > (best[0] if best else worth_now) + 1e-9:
                        best = worth, Condition(s, above, b)
        if best is None:
            break
        rule.append(best[1])
    return rule


def _covered(rows: DataFrame, rule: Sequence[Condition]) -> list[tuple[int, int]]:
    """How many documents of low and good quality the first 1, 2, ... conditions cover."""
    sums = [x for k in range(len(rule)) for x in (F.count_if(_all(rule[: k + 1]) & F.col("low")), F.count_if(_all(rule[: k + 1]) & ~F.col("low")))]
    got = rows.agg(*(x.alias(f"x{i}") for i, x in enumerate(sums))).first()
    return [(got[2 * k], got[2 * k + 1]) for k in range(len(rule))]


def _bin(statistic: str, cuts: Sequence[float]) -> Column:
    """How many thresholds a statistic is above."""
    value = F.col(statistic)
    above = F.filter(F.array(*map(F.lit, cuts)), lambda t: value > t) if cuts else F.array()
    return F.when(value.isNotNull(), F.size(above))


def learned(labelled: DataFrame) -> list[Rule]:
    """Rules for low quality, in order, by sequential covering.  labelled: low (boolean), doc_id and STATISTICS.

    Of what no rule covers yet, two thirds (by a hash of doc_id) grow a conjunction by m-estimates of precision, and the last third prunes it to
    the beginning that is best there, by (low - good) / (low + good).  It is taken if PRECISION of what it covers first is of low quality, and else the
    list ends.  Thresholds are quantiles.  Spark counts documents by statistic and bin; the driver sees these counts only.
    """
    own = labelled.select("low", F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)).alias("third"), *(F.col(s).cast("double") for s in STATISTICS))
    own = keep(own)
    at = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    got = own.agg(*(F.percentile(s, F.array(*map(F.lit, at))).alias(s) for s in STATISTICS)).first()
    cuts = [sorted({float(x) for x in got[s] or []}) for s in STATISTICS]
    bins = [_bin(s, c) for s, c in zip(STATISTICS, cuts)]
    rows = keep(own.select("low", "third", F.array(*bins).alias("bins")))
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        grow, prune = rows.filter("third < 2"), rows.filter("third = 2")
        rule = _grown(grow)
        if not rule:
            break
        there = _covered(prune, rule)
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in there]
        rule = rule[: worth.index(max(worth)) + 1]
        low, good = _covered(rows, rule)[-1]
        if low < LEAST or low < PRECISION * (low + good):
            break
        rules.append(Rule(tuple(c.plain(cuts) for c in rule), low, good))
        rows = rows.filter(~_all(rule))
    return rules


def sampled(labels: DataFrame, id_col: str, quality_col: str, rows: int) -> DataFrame:
    """doc_id and low of labelled documents, or, of more than `rows`, of those whose hash is below the share of that number.

    A hash has 63 bits, so that some are drawn from any number of labels.  Rows without id or label don't count; a document with several
    labels has the lowest.
    """
    own = labels.filter(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.min(quality_col) == 0).alias("low"))
    n = own.count()
    if n > rows:
        own = own.filter(place("doc_id", "fit") <= share(rows, n))
    return own


def judged(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, rule (the first that holds, as text, or null), kept.

    base_failed: under 50 words, or more than half of the words in windows that recur.  Null and empty texts have no words and fail.  Null
    and repeated ids are rows like any other, other columns are ignored, and an empty table gives an empty result.
    """
    rows = statistics(counted(docs, id_col, text_col))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    first = F.lit(None).cast("string")
    for r in reversed(rules):
        first = F.when(r.holds(), r.text()).otherwise(first)
    rows = rows.withColumn("base_failed", failed).withColumn("rule", first)
    names = [c for c in rows.columns if c not in STATISTICS or c == "n_words"]
    return rows.select(*names, (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def learned_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """The rules that labels teach; quality 0 is low.  Without labelled documents there are none, and judged() goes by the base alone.

    What is sent to the tasks are ids and labels of fit_rows documents.
    """
    few = sampled(labels, id_col, quality_col, fit_rows)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "doc_id")
    return learned(statistics(counted(own, others=["low"])))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, learned_from(docs, table(spark, sf_dir, "labels")))
