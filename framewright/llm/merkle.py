"""Merkle manifests of datasets: a tree for each group of rows, a tree over the groups, and a proof for every row."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import keep, table

STEP = 10  # levels that are folded at once: blocks of 1024 nodes
SENT = 1 << 15  # nodes of a level and those above are sent to the tasks from where so many of the level cover all leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # the number of the tree over the groups


def sha(*texts: Column) -> Column:
    """Lowercase hex of the SHA-256 of the texts' concatenation."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as its number of UTF-8 bytes, a colon and the value, or `-` if null."""
    text = [f.cast("string") for f in fields]
    return sha(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text))


def _hex(packed: Column) -> Column:
    return F.lower(F.hex(packed))


def levels(size: Column) -> Column:
    """How often the nodes of a tree of so many leaves are paired until one is left."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def width(size: Column, level: Column) -> Column:
    """How many nodes a tree of so many leaves has at a level."""
    one = F.lit(1).cast("long")
    return F.call_function("shiftright", size + F.call_function("shiftleft", one, level) - 1, level)


def indexed(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Numbers the rows of each group in order.  rows: a kept table.  Gives (rows with part and at, spans).

    Rows are dealt by ranges of group and order, so that a group of any size is spread over tasks, and sorted there.  `at` grows with the
    order; spans (group, part, first, offset, size) tell from which `at` on a group's rows stand in a part and how many stand in the
    parts before it: a row's index is at - first + offset.  There is a span for each part and each group, not more.
    """
    by = [*group, *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    kept = keep(dealt.withColumn("part", F.shiftright("at", 33)))
    spans = kept.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept, keep(spans.withColumn("offset", before).withColumn("size", F.sum("n").over(w)).drop("n"))


def nodes(leaves: DataFrame, most: int) -> DataFrame:
    """All nodes of some trees: tree, size, level, index, hash.  leaves: tree, size, index, hash (packed); most: the largest size.

    STEP levels at a time: blocks of 2^STEP neighbours are brought together, and a block's levels are computed where it is.
    """
    found = current = leaves.select("tree", "size", F.lit(0).alias("level"), "index", "hash")
    base = 0
    while most > 1:
        held = F.transform(F.array_sort(F.collect_list(F.struct("index", "hash"))), lambda x: _hex(x["hash"]))
        going = current.filter(width(F.col("size"), F.lit(base)) > 1)
        blocks = going.groupBy("tree", "size", F.shiftright("index", STEP).alias("block")).agg(held.alias("now"))

        def step(acc: Column, j: Column) -> Column:
            now, level = acc["now"], j + base  # noqa: B023
            pairs = F.sequence(F.lit(0), F.floor((F.size(now) - 1) / 2).cast("int"))
            up = F.transform(pairs, lambda i: sha(F.get(now, 2 * i), F.coalesce(F.get(now, 2 * i + 1), F.lit(""))))
            goes = width(F.col("size"), level) > 1
            more = F.struct(F.when(goes, up).otherwise(now).alias("now"), F.when(goes, level + 1).alias("level"))
            return F.struct(more["now"].alias("now"), F.concat(acc["out"], F.array(more)).alias("out"))

        none = F.expr("cast(array() as array<struct<now: array<string>, level: int>>)")
        made = F.aggregate(F.sequence(F.lit(0), F.lit(STEP - 1)), F.struct("now", none.alias("out")), step, lambda acc: acc["out"])
        made = blocks.select("tree", "size", "block", F.inline(made)).filter("level is not null")
        made = made.select("tree", "size", "block", "level", F.posexplode("now").alias("i", "h"))
        place = F.expr(f"shiftleft(block, {STEP + base} - level) + i")
        made = keep(made.select("tree", "size", "level", place.alias("index"), F.unhex("h").alias("hash")))
        found = found.unionByName(made)
        base += STEP
        current = made.filter(F.col("level") == base)
        most = math.ceil(most / (1 << STEP))
    return found


def roots(found: DataFrame) -> DataFrame:
    """The last node of each tree: tree, root (hex)."""
    return found.filter(width(F.col("size"), F.col("level")) == 1).select("tree", _hex(F.col("hash")).alias("root"))


def paths(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """rows: at (a number of each row's own), tree, size, index, and others; found: nodes() of their trees; total: how many leaves these have.
    Adds path: array of (right, sibling), from the leaf up; right tells that the node itself is the second of the two, sibling is null where it is alone.

    Every row explodes the coordinates of the siblings that it needs, which its index and its tree's size tell, and joins them with
    the table of nodes.  A node of level k is wanted by 2^k leaves.  From the level on where SENT nodes cover all leaves, there are at most 4 * SENT
    nodes, which are sent to the tasks; below it no node is wanted by more than 1 / SENT of all leaves, so the shuffle has no hot key.
    """
    size, level = F.col("size"), F.col("level")
    wanted = rows.filter(size > 1).select("at", "tree", "size", "index", F.explode(F.sequence(F.lit(0), levels(size) - 1)).alias("level"))
    sibling = F.call_function("shiftright", F.col("index"), level).bitwiseXOR(F.lit(1).cast("long"))
    wanted = wanted.withColumn("index", sibling).filter(F.col("index") < width(size, level)).drop("size")
    cut = max(0, math.ceil(math.log2(max(total, 1) / SENT)))
    inner = found.filter(width(size, level) > 1).select("tree", "level", "index", "hash")
    key = ["tree", "level", "index"]
    got = wanted.filter(level >= cut).join(F.broadcast(inner.filter(level >= cut)), key)
    if cut:
        got = got.unionByName(wanted.filter(level < cut).join(inner.filter(level < cut), key))
    got = got.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("level", "hash"))).alias("siblings"))
    rows = rows.join(got, "at", "left")
    right = lambda k: F.call_function("shiftright", F.col("index"), k).bitwiseAND(F.lit(1).cast("long")) == 1
    entry = lambda k: F.struct(right(k).alias("right"), _hex(F.try_element_at("siblings", k)).alias("sibling"))
    none = F.expr("cast(array() as array<struct<right: boolean, sibling: string>>)")
    return rows.withColumn("path", F.when(size > 1, F.transform(F.sequence(F.lit(0), levels(size) - 1), entry)).otherwise(none)).drop("siblings")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path come to."""

    def up(acc: Column, p: Column) -> Column:
        both = F.when(p["right"], sha(p["sibling"], acc)).otherwise(sha(acc, p["sibling"]))
        return F.when(p["sibling"].isNull(), sha(acc)).otherwise(both)

    return F.aggregate(path, digest, up)


@dataclass(frozen=True)
class Manifest:
    leaves: DataFrame  # at, part, tree, size, index, hash, doc_id, group, and what was carried along
    groups: DataFrame  # group, tree, subroot, root, path of the subroot to the root
    nodes: DataFrame  # tree, size, level, index, hash (packed) of the groups' trees
    spans: DataFrame  # group, part, tree

    def proofs(self) -> DataFrame:
        """One row per leaf: what leaves has, leaf (hex), subroot, root, and path, all the way to the root."""
        total = self.nodes.filter("level = 0").count()
        own = paths(self.leaves, self.nodes, total)
        of = self.spans.join(self.groups.withColumnRenamed("path", "above"), "tree").select("part", "tree", "subroot", "root", "above")
        return own.join(of, ["part", "tree"]).withColumn("path", F.concat("path", "above")).withColumn("leaf", _hex(F.col("hash"))).drop("above", "hash")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS, carry: dict[str, Column] | None = None) -> Manifest:
    """The trees of docs: each row is a leaf; per group, leaves ascend by id; the groups' roots, by group, are the leaves of the tree over them.

    Pairs of neighbours become their digest, and a last one without a neighbour the digest of itself, until one node is left.  Nulls:
    null ids come first in their group; null is a group, and the first; a null field is `-`.  Rows of equal id are ordered by their leaf, and
    rows alike in all fields are leaves like any others.  An empty table gives an empty manifest.  carry: columns of docs to keep
    with the leaves; all other columns are ignored.

    Texts are read once, for the digests; what is shuffled are digests of 32 bytes and their places.
    """
    more = carry or {}
    rows = keep(docs.select(
        F.col(id_col).alias("doc_id"), F.col(group_col).alias("group"), F.unhex(leaf(*(F.col(f) for f in fields))).alias("hash"),
        F.monotonically_increasing_id().alias("rid"), *(c.alias(n) for n, c in more.items()),
    ))
    kept, spans = indexed(rows, ["group"], ["doc_id", "hash", "rid"])
    names, places = indexed(keep(spans.select("group", F.col("size").alias("leaves")).distinct()), [], ["group"])
    groups = keep(names.join(places, "part").select("group", (F.col("at") - F.col("first") + F.col("offset")).alias("tree"), "leaves", "size"))
    of = groups.select(F.col("group").alias("own"), "tree")
    spans = keep(spans.join(of, F.col("group").eqNullSafe(F.col("own"))).drop("own"))
    place = spans.select(F.col("part").alias("in"), F.col("group").alias("own"), "tree", "first", "offset", "size")
    leaves = kept.join(place, (F.col("part") == F.col("in")) & F.col("group").eqNullSafe(F.col("own"))).withColumn("index", F.col("at") - F.col("first") + F.col("offset"))
    leaves = keep(leaves.drop("in", "own", "first", "offset", "rid"))
    most = spans.agg(F.max("size")).first()[0] or 0
    trees = nodes(leaves, most)
    n = groups.count()
    top = keep(groups.drop("leaves").join(roots(trees), "tree").select(F.lit(TOP).cast("long").alias("tree"), "size", F.col("tree").alias("index"), F.unhex("root").alias("hash")))
    over = nodes(top, n)
    ways = paths(top.withColumn("at", F.col("index")), over, n)
    root = roots(over).first()
    found = ways.select(F.col("index").alias("tree"), _hex(F.col("hash")).alias("subroot"), F.lit(root["root"] if root else None).cast("string").alias("root"), "path")
    return Manifest(leaves, keep(groups.select("group", "tree").join(found, "tree")), trees, spans.select("group", "part", "tree"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = [F.col("n_chars").cast("decimal(20,0)") + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    struck = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    proofs = manifest(docs, carry={"tampered": F.when(struck, F.unhex(leaf(*tampered)))}).proofs()
    got = proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", F.transform("path", lambda p: p["sibling"])).cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce(_hex(F.col("tampered")), F.col("leaf")), F.col("path")).alias("folded_root"),
    )
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


# crc32 is taken bit by bit, the trees level by level, and a proof is folded over the list of its siblings.
OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT doc_id, lang, n_chars,
         list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)), lambda a, b:
           list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) AS c,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
         coalesce(strlen(text) || ':' || text, '-') AS after
  FROM documents
), l AS (
  SELECT doc_id, lang, leaf, CASE WHEN xor(c, 4294967295::UBIGINT) % 7 = 0 THEN sha256(before || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || after) ELSE leaf END AS told,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT *, sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || after) AS leaf FROM v)
), nodes AS (
  SELECT lang, 0 AS level, i, n AS w, leaf AS h FROM l
  UNION ALL
  SELECT lang, level + 1, i // 2, (max(w) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE w > 1 GROUP BY lang, level, i // 2
), g AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE w = 1
), tops AS (
  SELECT 0 AS level, i, n AS w, subroot AS h FROM g
  UNION ALL
  SELECT level + 1, i // 2, (max(w) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE w > 1 GROUP BY level, i // 2
), way AS (
  SELECT l.lang, l.i, list({'r': (l.i >> o.level) & 1, 'h': s.h} ORDER BY o.level) AS p
  FROM l JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.i = l.i >> o.level AND o.w > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM o.lang AND s.level = o.level AND s.i = xor(o.i, 1) GROUP BY ALL
), above AS (
  SELECT g.i, list({'r': (g.i >> o.level) & 1, 'h': s.h} ORDER BY o.level) AS p
  FROM g JOIN tops o ON o.i = g.i >> o.level AND o.w > 1 LEFT JOIN tops s ON s.level = o.level AND s.i = xor(o.i, 1) GROUP BY ALL
), whole AS (
  SELECT l.*, g.subroot, (SELECT h FROM tops WHERE w = 1) AS root, list_concat(coalesce(way.p, []), coalesce(above.p, [])) AS p
  FROM l JOIN g ON g.lang IS NOT DISTINCT FROM l.lang LEFT JOIN way ON way.lang IS NOT DISTINCT FROM l.lang AND way.i = l.i LEFT JOIN above ON above.i = g.i
)
SELECT *, folded_root = root AS verified FROM (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(p, lambda x: x.h IS NOT NULL), lambda x: x.h), '')) AS proof_sha256,
         list_reduce(list_prepend({'r': 0::BIGINT, 'h': told}, p), lambda a, b: {'r': 0::BIGINT, 'h': CASE WHEN b.h IS NULL THEN sha256(a.h) WHEN b.r = 1 THEN sha256(b.h || a.h) ELSE sha256(a.h || b.h) END}).h AS folded_root
  FROM whole
)
"""
