"""DuckDB SQL for the queries of this folder."""

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
_UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

_LADDER = """
v AS (SELECT p_brand AS brand, p_partkey AS n, CASE WHEN p_size % 3 > 0 THEN p_size * 36 END AS height, p_size * 1000 + p_partkey % 2 AS bandwidth FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY brand, CASE WHEN height IS NULL THEN 'b' || bandwidth ELSE 'h' || height END ORDER BY n) AS k FROM v),
l AS (SELECT brand, n, height, bandwidth, (row_number() OVER (PARTITION BY brand ORDER BY height NULLS FIRST, bandwidth, n) - 1)::INT AS rung FROM o WHERE k = 1)
"""

SQL = {
    "ladder_rungs": f"WITH {_LADDER} SELECT * FROM l",
    "active_rung": f"""
WITH {_LADDER}
SELECT p_partkey, p_brand AS brand, coalesce(
  (SELECT min(rung) FROM l WHERE l.brand = p_brand AND l.height = p_size * 36), (SELECT min(rung) FROM l WHERE l.brand = p_brand AND l.bandwidth = p_size * 1000),
  (SELECT max(rung) FROM l WHERE l.brand = p_brand)) AS rung
FROM part
""",
    "mime_rewrite": """
SELECT p_partkey, p_size % 3 <> 0 AND p_size % 2 = 0 AS muxed, p_size % 3 <> 0 AND p_size % 2 <> 0 AS transmux,
       'video/mp4; codecs="' || CASE WHEN p_size % 3 = 0 THEN 'avc1.640028' ELSE 'avc1.x' END || CASE WHEN p_size % 2 = 0 THEN ',mp4a.40.2' ELSE '' END || '"' AS rewritten
FROM part
""",
    "reference_lists": "SELECT c_custkey, i::INT AS place, c_custkey + i % 4 AS picture FROM (SELECT c_custkey, unnest(range(c_custkey % 7 + 1)) AS i FROM customer)",
    "tile_scan": """
WITH c AS (SELECT p_partkey, p_partkey // 200 AS picture, p_partkey % 20 AS x, p_partkey % 200 // 20 AS y FROM part),
t AS (SELECT *, CASE WHEN y >= 4 THEN 3 ELSE 0 END + CASE WHEN x >= 13 THEN 2 WHEN x >= 7 THEN 1 ELSE 0 END AS tile FROM c)
SELECT p_partkey, tile, (row_number() OVER (PARTITION BY picture ORDER BY tile, y, x) - 1)::INT AS scan FROM t
""",
    "neighbour_cells": """
WITH c AS (SELECT p_partkey // 200 AS picture, p_partkey % 20 AS gx, p_partkey % 200 // 20 AS gy, p_size FROM part)
SELECT c.picture, c.gx, c.gy, c.p_size, a.p_size AS left, b.p_size AS above
FROM c LEFT JOIN c a ON a.picture = c.picture AND a.gx = c.gx - 1 AND a.gy = c.gy LEFT JOIN c b ON b.picture = c.picture AND b.gx = c.gx AND b.gy = c.gy - 1
""",
    "generation_filter": f"""
WITH s AS (SELECT user_id, event_id, (count(*) FILTER (event_type = 'signup') {_W} {_UP})::BIGINT AS generation FROM events)
SELECT * FROM s QUALIFY generation = max(generation) OVER (PARTITION BY user_id)
""",
    "rebase_times": """
WITH g AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS dts, max(l_suppkey) AS pts, min(l_quantity::BIGINT) AS base FROM lineitem GROUP BY ALL),
f AS (SELECT l_orderkey, min(base) FILTER (base > 10) AS tfdt, min_by(dts, l_linenumber) AS first FROM g GROUP BY 1)
SELECT l_orderkey, l_linenumber, dts - coalesce(first - tfdt, 0) AS dts, pts - coalesce(first - tfdt, 0) AS pts FROM g JOIN f USING (l_orderkey)
""",
    "rolling_speed": f"SELECT user_id, event_id, round(avg(value) {_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS mean FROM events",
    "compute_aware_cap": """
WITH RECURSIVE e AS (
  SELECT user_id, event_id, value / 40 AS speed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), s AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::INT AS cap, 0 AS low, 0 AS high, NULL::DOUBLE AS last, NULL::DOUBLE AS mean_speed, '' AS reason
  FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, n, event_id,
         CASE WHEN lowers THEN coalesce(cap, 3) - 1 WHEN raises THEN cap + 1 ELSE cap END,
         0, CASE WHEN last IS NULL THEN high WHEN lowers OR raises OR mean <= 1.3 OR high + 1 >= 6 THEN 0 ELSE high + 1 END,
         CASE WHEN lowers OR raises THEN NULL ELSE speed END, mean,
         CASE WHEN last IS NULL THEN 'init' WHEN lowers THEN 'lower' WHEN raises THEN 'raise' ELSE 'hold' END
  FROM (
    SELECT *, last IS NOT NULL AND mean < 1 AND coalesce(cap, 3) > 0 AS lowers,
           coalesce(last IS NOT NULL AND mean > 1.3 AND high + 1 >= 6 AND cap IS NOT NULL AND cap < 3, false) AS raises
    FROM (
      SELECT s.user_id, e.n, e.event_id, s.cap, s.high, s.last, e.speed, CASE WHEN s.last IS NULL THEN e.speed ELSE (s.last + e.speed) / 2 END AS mean
      FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1
    )
  )
)
SELECT user_id, event_id, coalesce(cap, -1) AS cap, round(mean_speed, 6) AS mean_speed, reason FROM s WHERE n > 0
""",
    "counter_unwrap": """
WITH RECURSIVE e AS (
  SELECT user_id, event_id, (event_id % 16)::INT AS low, event_type <> 'click' AS anchor, event_type = 'signup' AS reset,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), s AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0 AS prev, 0 AS high, 0 AS full_ FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, n, event_id, CASE WHEN reset THEN 0 WHEN anchor THEN low ELSE prev END,
         CASE WHEN reset THEN 0 WHEN anchor THEN msb ELSE high END, CASE WHEN reset THEN low ELSE msb + low END
  FROM (
    SELECT s.user_id, e.n, e.event_id, e.low, e.anchor, e.reset, s.prev, s.high,
           s.high + CASE WHEN e.low < s.prev AND s.prev - e.low >= 8 THEN 16 WHEN e.low > s.prev AND e.low - s.prev > 8 THEN -16 ELSE 0 END AS msb
    FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1
  )
)
SELECT user_id, event_id, full_::BIGINT AS "full" FROM s WHERE n > 0
""",
    "sequence_number": f"SELECT user_id, event_id, (count(*) FILTER (event_type = 'signup') {_W} {_UP})::BIGINT AS seq FROM events",
    "display_order": f"""
WITH s AS (SELECT user_id, event_id, value, (count(*) FILTER (event_type = 'signup') {_W} {_UP})::BIGINT AS seq FROM events)
SELECT user_id, event_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq, value, event_id)::INT AS position FROM s
""",
    "next_gap_duration": f"""
WITH s AS (SELECT user_id, event_id, ts, epoch_us(lead(ts) {_W})) - epoch_us(ts) AS step FROM events)
SELECT user_id, event_id, coalesce(step, first_value(step) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS duration FROM s
""",
    "contiguous_ranges": f"""
WITH s AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, epoch_us(ts) - epoch_us(lag(ts) {_W})) > 21600000000 AS far FROM events),
r AS (SELECT user_id, us, (sum(CASE WHEN far THEN 1 ELSE 0 END) {_W} {_UP})::BIGINT AS range_no FROM s)
SELECT user_id, range_no, min(us) AS start, max(us) AS "end", count(*) AS n FROM r GROUP BY ALL
""",
    "session_group": f"""
WITH s AS (SELECT user_id, event_id, value, (sum(CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END) {_W} {_UP})::BIGINT AS group_no FROM events)
SELECT user_id, group_no, count(*) AS n, round(sum(value), 4) AS total, min(event_id) AS first_event FROM s GROUP BY ALL
""",
    "ladder_dedup": """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part)
SELECT p_size, p_partkey, p_retailprice, (row_number() OVER (ORDER BY p_size) - 1)::INT AS rung FROM f WHERE k = 1
""",
    "asof_config": """
SELECT p.user_id, p.event_id, p.value, max_by(s.value, (s.ts, s.event_id)) AS config_value
FROM events p LEFT JOIN events s
  ON s.user_id = p.user_id AND s.event_type = 'signup' AND (s.ts < p.ts OR (s.ts = p.ts AND s.event_id < p.event_id))
WHERE p.event_type = 'purchase' GROUP BY ALL
""",
    "ref_mark": """
SELECT o_orderkey, o_orderstatus, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS referenced FROM orders
""",
    "ordinal_zip": """
WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders),
b AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank FROM orders)
SELECT a.o_custkey, a.rank::INT AS rank, o_orderkey, o_totalprice FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.rank = b.rank
""",
    "inherit_last": f"SELECT user_id, event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) {_W} {_UP} AS inherited FROM events",
    "frame_quality": """
WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
d AS (SELECT vec_id, i, floor(x::DOUBLE * 127 + 0.5) AS a FROM v),
e AS (SELECT vec_id, i, abs(a - floor(a / 8) * 8) AS d FROM d)
SELECT vec_id, max(d) AS max_abs, count(*) FILTER (d > 0) AS n_diff, min(i) FILTER (d > 0) AS first_diff,
       CASE WHEN sum(d * d) = 0 THEN 'inf'::DOUBLE ELSE round(10 * log10(65025 / (sum(d * d) / count(*))), 6) END AS psnr
FROM e GROUP BY vec_id
""",
    "codec_level": """
SELECT p_partkey, 'hvc1.1.6.L' || (p_size * 4) || '.90' AS codec,
       CASE WHEN p_size * 4 >= 150 THEN 'avc1.640033' WHEN p_size * 4 >= 120 THEN 'avc1.64002a' ELSE 'avc1.640028' END AS by_level,
       CASE WHEN p_size * p_size * 2304 > 2073600 THEN 'avc1.640033' WHEN p_size * p_size * 2304 > 921600 THEN 'avc1.64002a' ELSE 'avc1.640028' END AS by_pixels
FROM part
""",
    "exp_golomb": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, repeat('0', length(bin(v + 1)) - 1) || bin(v + 1) AS code,
       (2 * length(bin(v + 1)) - 1)::BIGINT AS bits, v AS back, CASE WHEN v % 2 = 1 THEN (v + 1) // 2 ELSE -(v // 2) END AS signed
FROM (SELECT *, l_partkey % 1000 AS v FROM lineitem)
""",
    "chunk30": f"""
WITH s AS (SELECT user_id, event_id, ((row_number() {_W}) - 1) // 30)::INT AS batch FROM events)
SELECT user_id, batch, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY ALL
""",
    "retention": """
SELECT user_id, event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS newest FROM events) WHERE ts >= newest - INTERVAL 3 DAY
""",
    "block_transform": """
WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
q AS (SELECT vec_id, (i // 4)::INT AS block, i % 4 AS j, floor(x::DOUBLE * 1000 + 0.5)::INT AS x FROM v),
m(k, j, w) AS (VALUES (0,0,64),(0,1,64),(0,2,64),(0,3,64),(1,0,83),(1,1,36),(1,2,-36),(1,3,-83),(2,0,64),(2,1,-64),(2,2,-64),(2,3,64),(3,0,36),(3,1,-83),(3,2,83),(3,3,-36)),
c AS (SELECT vec_id, block, k, sum(x * w)::INT AS y FROM q JOIN m USING (j) GROUP BY ALL)
SELECT vec_id, block, max(y) FILTER (k = 0) AS c0, max(y) FILTER (k = 1) AS c1, max(y) FILTER (k = 2) AS c2, max(y) FILTER (k = 3) AS c3 FROM c GROUP BY ALL
""",
    "best_of_runs": "SELECT user_id, event_type, min(value) AS best, round(avg(value), 6) AS mean, count(*) AS runs FROM events GROUP BY ALL",
    "segment_speed": """
SELECT l_orderkey, CASE WHEN sum(l_quantity) > 0 THEN sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / sum(l_quantity::BIGINT)::DOUBLE END AS speed FROM lineitem GROUP BY 1
""",
}
