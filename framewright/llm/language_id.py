"""Language identification by prediction by partial matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bytegrams import Values, blocks, counted, find, mask
from .shared import MOST, place, share, ship, table

ORDER = 3  # bytes of the longest context
ROWS_PER_LANG = 3000  # learn from about so many rows of each language, at most
UND = "und"
MOST_BITS = 8.0  # to a byte: what no language's trees code in fewer is in none of the learned languages
SLACK = 64.0  # bits that a text may take beyond that, so that a short one isn't judged by a few odd letters
LETTER = regex.compile(r"\p{L}")


class Trees:
    """Context trees of one language: for each order, how often each symbol followed each context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int):
        self.levels = []
        for k in range(order + 1):
            g, at = np.unique(grams & mask(k + 1), return_inverse=True)
            c = np.bincount(at, counts).astype(np.float64)
            ctx, at = np.unique(g >> np.uint64(8), return_inverse=True)
            self.levels.append((g, c, ctx, np.bincount(at, c), np.bincount(at).astype(np.float64)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of each n-gram's last byte after those before it.

        A context that has been seen codes a symbol that followed it with count / (all + kinds), or else an
        escape with kinds / (all + kinds) and then the symbol after one byte less; a context never seen costs
        nothing; without any context all 256 bytes are alike.  The counts are frozen.
        """
        cost = np.full(len(grams), 8.0)
        for k, (g, c, ctx, total, kinds) in enumerate(self.levels):
            here = (grams & mask(k + 1)) >> np.uint64(8)
            n, t, d = find(g, c, grams & mask(k + 1)), find(ctx, total, here), find(ctx, kinds, here)
            with np.errstate(divide="ignore"):
                own = -np.log2(np.maximum(n, 1e-300) / np.maximum(t + d, 1e-300))
                escape = -np.log2(np.maximum(d, 1e-300) / np.maximum(t + d, 1e-300))
            cost = np.where(n > 0, own, np.where(t > 0, escape + cost, cost))
        return cost


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def fit(rows: DataFrame, order: int = ORDER, rows_per_lang: int = ROWS_PER_LANG) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts of the (order + 1)-grams of each language in rows (doc_id, text, lang).

    A language with more rows than rows_per_lang is learned from about that many of them, drawn by a
    hash of 63 bits of the doc_id; so the model's size doesn't grow with the input, and however many rows there are, those of the
    smallest hash are drawn at least.
    """
    drawn_by = place("doc_id", "ppm")
    have = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(drawn_by).alias("least")).collect()}
    if not have:
        return {}
    most = F.lit(MOST)
    for lang, (n, least) in have.items():
        most = F.when(F.col("lang") == lang, F.lit(max(least, share(rows_per_lang, n)))).otherwise(most)
    drawn = rows.filter(drawn_by <= most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                langs, texts = (x.to_pylist() for x in batch.slice(at, 500).columns)
                for lang in sorted(set(langs)):
                    own = [t.encode() for t, x in zip(texts, langs) if x == lang]
                    g, c = counted([x[1] for x in blocks(own, order + 1)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"]
                    )

    grams = drawn.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    got = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = got.column("lang").to_numpy(), got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    out = {}
    for x in sorted(have):
        at = np.flatnonzero(lang == x)
        at = at[np.argsort(gram[at])]
        out[x] = (gram[at], n[at])
    return out


class Judge:
    def __init__(self, model: dict[str, tuple[np.ndarray, np.ndarray]], order: int):
        self.langs, self.n = sorted(model), order + 1
        trees = [Trees(*model[x], order) for x in self.langs]
        self.values = Values(lambda g: np.stack([t.bits(g) for t in trees], 1), len(trees)) if trees else None

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Of each text the language, its score, and by how many bits it misses MOST_BITS a byte (0 if it doesn't)."""
        fine = [i for i, t in enumerate(texts) if t and self.langs and LETTER.search(t)]
        raw = [texts[i].encode() for i in fine]
        cost = np.zeros((len(fine), len(self.langs)))
        for _, grams, starts, which in blocks(raw, self.n) if fine else ():
            np.add.at(cost, which, np.add.reduceat(self.values[grams], starts, axis=0, dtype=np.float64))
        lang, score, missed = [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not fine:
            return lang, score, missed
        best = cost.argmin(1)
        for j, i in enumerate(fine):
            # the posterior at equal priors, bits counted as if n bytes were sqrt(n) independent ones
            odds = np.exp2(-(cost[j] - cost[j, best[j]]) / np.sqrt(len(raw[j])))
            lang[i], score[i], missed[i] = self.langs[best[j]], float(1 / odds.sum()), max(0.0, float(cost[j, best[j]] - MOST_BITS * len(raw[j])))
        return lang, score, missed


def identify(docs: DataFrame, model: dict, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row of docs; see predict_language."""
    ship(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Judge(model, order)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lang, score, _ = of(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, lang_pred string, score double")


def learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, fold: int) -> DataFrame:
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    return rows.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out(F.col("doc_id"), folds, fold))


def predict_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2,
    order: int = ORDER, rows_per_lang: int = ROWS_PER_LANG,
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang of rows whose crc32(doc_id as text) mod folds is not fold; the rest is
    held out.  A text's language is the one whose context trees code its bytes in the fewest bits, of equal ones
    the first by name; score is that language's share of the odds.  `und` with score 0 is predicted for null texts, for texts
    without a letter, and for all where no row can be learned from.  Rows with a null doc_id are judged, not
    learned from.  Repeated rows count each; an empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    model = fit(learnable(docs, id_col, text_col, lang_col, folds, fold), order, rows_per_lang)
    found = identify(docs, model, order, id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, text_col: str = "text", order: int = ORDER, slack: float = SLACK, **fitting) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...), whole, whose language can be told.

    Rows predicted `und` (null texts, texts without a letter, and all if no language can be learned) go; so do texts that no
    learned language's trees code in MOST_BITS a byte and `slack` bits more: sent as raw bytes they would be shorter, so
    they are in none of these languages.  An empty table gives an empty result; rows of null doc_id are judged like
    others; other columns may have any name.  No row is shuffled.  See predict_language for what is learned.
    """
    ship(docs.sparkSession)
    given = {"id_col": "doc_id", "lang_col": "lang", "folds": 4, "fold": 2} | fitting
    rows_per_lang = given.pop("rows_per_lang", ROWS_PER_LANG)
    model = fit(learnable(docs, text_col=text_col, **given), order, rows_per_lang)
    at_text = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Judge(model, order)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lang, _, missed = of(part.column(at_text).to_pylist())
                yield part.filter(pa.array([x != UND and y <= slack for x, y in zip(lang, missed)], pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))
