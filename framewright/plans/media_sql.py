"""DuckDB SQL for media_queries."""

from .sql import _BEFORE, _LADDER, _UP, _W, SQL as _SQL

_CLIP = "greatest(0.0, least(1.0, {}))"
_UNIT = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 19 WHEN 'purchase' THEN 40 WHEN 'signup' THEN 34 ELSE 36 END"
_SWAPPED = "s AS (SELECT user_id, n AS decode_idx, xor(n, 1) AS poc FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events))"
_SETS = """
pps AS (SELECT user_id, ts, event_id, event_id % 3 AS pps_id, event_id % 2 AS sps_id FROM events WHERE event_type = 'click'),
sps AS (SELECT user_id, ts, event_id, event_id % 2 AS sps_id, value FROM events WHERE event_type = 'view')
"""
_HELD = "h AS (SELECT user_id, event_id % 37 AS poc, event_id AS picture, event_type = 'view' AS short FROM events WHERE event_type NOT IN ('error', 'signup'))"

SQL = {
    "collocated_pictures": """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 5 < 4 THEN c_custkey + c_custkey % 5 - 1 END
       ELSE CASE WHEN c_custkey % 5 < 3 THEN c_custkey + c_custkey % 5 + 2 END END AS picture FROM customer
""",
    "time_bases": """
SELECT p_partkey, p_partkey * 40000 AS micros, CASE WHEN p_size % 7 > 0 THEN round(12800 / (p_size % 7), 6) END AS fps, ceil(p_partkey * 37 / 1000)::BIGINT AS kbps FROM part
""",
    "bit_arithmetic": """
SELECT p_partkey, greatest(20, least(150, p_partkey)) AS held, length(ltrim(bin(p_partkey + 1), '0'))::INT AS bits, floor(p_size / 2 - 10 + 0.5)::BIGINT AS rounded FROM part
""",
    "reference_sets": """
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
-- a picture holds what the one before named and itself; five back is named by none in between, so it is never held
k AS (SELECT user_id, n, n % 8 AS r FROM e)
SELECT user_id, n AS decode_idx,
       concat_ws(',', CASE WHEN r >= 1 THEN n - 1 END, CASE WHEN r >= 2 THEN n - 2 END) AS before,
       CASE WHEN r >= 3 THEN (n - 3)::VARCHAR ELSE '' END AS follow,
       CASE WHEN r = 0 THEN '' ELSE concat_ws(',', CASE WHEN r < 2 THEN n - 2 END, CASE WHEN r < 3 THEN n - 3 END, n - 5) END AS missing
FROM k
""",
    "unit_kinds": """
SELECT p_partkey, t < 32 AS vcl, t BETWEEN 16 AND 23 AS irap, t IN (19, 20) AS idr, t = 21 AS cra, t BETWEEN 16 AND 18 AS bla, t IN (8, 9) AS rasl, t IN (6, 7) AS radl
FROM (SELECT p_partkey, p_partkey % 64 AS t FROM part)
""",
    "unit_routing": "SELECT p_partkey, CASE WHEN p_partkey % 64 BETWEEN 32 AND 34 THEN 'parameters' WHEN p_partkey % 64 < 32 THEN 'slices' ELSE 'skipped' END AS route FROM part",
    "depth_reduction": """
SELECT vec_id, (i - 1)::INT AS i, least(greatest(0, least(1023, floor((embedding[i]::DOUBLE + 1) * 512)))::INT >> 2, 255) AS sample
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
""",
    "crop_windows": """
SELECT p_partkey, p_partkey % 3 * sx AS x, p_partkey % 5 * sy AS y, p_size * 16 - (p_partkey % 3 + p_partkey % 2) * sx AS width, p_size * 8 - (p_partkey % 5 + 1) * sy AS height
FROM (SELECT *, CASE WHEN p_partkey % 4 IN (1, 2) THEN 2 ELSE 1 END AS sx, CASE WHEN p_partkey % 4 = 1 THEN 2 ELSE 1 END AS sy FROM part)
""",
    "rgb": f"""
SELECT p_partkey, round({_CLIP.format("y + 1.5748::DOUBLE * v")}, 6) AS r, round({_CLIP.format("y - 0.1873::DOUBLE * u - 0.4681::DOUBLE * v")}, 6) AS g, round({_CLIP.format("y + 1.8556::DOUBLE * u")}, 6) AS b
FROM (SELECT p_partkey, p_size / 50 AS y, p_partkey % 256 / 255 - 0.5::DOUBLE AS u, p_partkey % 100 / 99 - 0.5::DOUBLE AS v FROM part)
""",
    "log_filter": """
SELECT * FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END AS level FROM events) WHERE level <> 'debug'
""",
    "bounded_fetch": """
SELECT vec_id, CASE WHEN ok THEN round(embedding[i + 1]::DOUBLE, 6) END AS value, NOT ok AS error
FROM (SELECT vec_id, embedding, (vec_id % 200 - 20)::INT AS i, vec_id % 200 - 20 BETWEEN 0 AND len(embedding) - 1 AS ok FROM embeddings)
""",
    "parameter_upsert": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "parameter_sets_accepted": f"""
WITH {_SETS}
SELECT user_id, event_id, pps_id, sps_id FROM pps
WHERE EXISTS (FROM sps WHERE sps.user_id = pps.user_id AND sps.sps_id = pps.sps_id AND (sps.ts, sps.event_id) < (pps.ts, pps.event_id))
""",
    "slice_resolution": f"""
WITH {_SETS}, s AS (SELECT user_id, ts, event_id, event_id % 3 AS pps_id FROM events WHERE event_type = 'purchase'),
one AS (
  SELECT s.user_id, s.ts, s.event_id, s.pps_id, p.sps_id FROM s LEFT JOIN pps p ON p.user_id = s.user_id AND p.pps_id = s.pps_id AND (p.ts, p.event_id) < (s.ts, s.event_id)
  QUALIFY row_number() OVER (PARTITION BY s.event_id ORDER BY p.ts DESC NULLS LAST, p.event_id DESC) = 1
)
SELECT o.user_id, o.event_id, o.pps_id, o.sps_id, p.value AS sps_value FROM one o LEFT JOIN sps p ON p.user_id = o.user_id AND p.sps_id = o.sps_id AND (p.ts, p.event_id) < (o.ts, o.event_id)
QUALIFY row_number() OVER (PARTITION BY o.event_id ORDER BY p.ts DESC NULLS LAST, p.event_id DESC) = 1
""",
    "reference_by_poc": f"""
WITH {_HELD}, w AS (SELECT user_id, event_id AS for_picture, (event_id + 5) % 37 AS poc FROM events WHERE event_type = 'purchase')
SELECT *, (SELECT min(picture) FROM h WHERE h.user_id = w.user_id AND h.poc = w.poc) AS picture,
       (SELECT min(picture) FROM h WHERE h.user_id = w.user_id AND h.poc = w.poc AND h.short) AS short_picture
FROM w
""",
    "reference_by_low_bits": f"""
WITH {_HELD}, w AS (SELECT user_id, event_id AS for_picture, event_id % 101 AS poc FROM events WHERE event_type = 'purchase')
SELECT *, (SELECT min(picture) FROM h WHERE h.user_id = w.user_id AND h.poc % 8 = w.poc % 8) AS picture FROM w
""",
    "correlated": """
SELECT a.event_id // 2 AS id, a.event_id AS request, b.event_id AS response, b.event_id IS NULL AS pending
FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1 AND b.event_type <> 'error' WHERE a.event_id % 2 = 0
""",
    "slice_headers": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus, o_custkey FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'
""",
    "temporal_vectors": """
WITH c AS (SELECT p_partkey, p_partkey // 64 AS picture, p_partkey % 8 * 16 AS x, p_partkey % 64 // 8 * 16 AS y, p_size, CASE WHEN p_size % 2 = 0 THEN 16 ELSE 32 END AS h FROM part),
m AS (SELECT picture, x, y, p_size AS vector FROM c WHERE p_size % 3 > 0)
SELECT c.p_partkey, coalesce(a.vector, b.vector) AS vector FROM c
LEFT JOIN m a ON a.picture = c.picture AND c.x + 16 < 128 AND c.y + c.h < 128 AND c.y // 32 = (c.y + c.h) // 32 AND a.x = c.x + 16 AND a.y = c.y + c.h
LEFT JOIN m b ON b.picture = c.picture AND b.x = (c.x + 8) // 16 * 16 AND b.y = (c.y + c.h // 2) // 16 * 16
""",
    "init_cache": "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_type, p_brand) AS made_for FROM part",
    "any_flag": 'SELECT l_orderkey, bool_or(l_discount > 0.085) AS "offset" FROM lineitem GROUP BY 1',
    "digests": "SELECT user_id, md5(string_agg(event_type, '' ORDER BY ts, event_id)) AS digest, sum(length(event_type))::BIGINT AS bytes FROM events GROUP BY 1",
    "reconciled": """
WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, o_orderkey IS NOT NULL AS in_test, l_orderkey IS NOT NULL AS in_reference FROM a FULL JOIN b ON o_orderkey = l_orderkey
""",
    "access_units": f"""
WITH u AS (SELECT user_id, ts, event_id, {_UNIT} AS t, event_id % 3 = 0 AS f FROM events),
k AS (SELECT *, CASE WHEN t < 32 THEN 1 WHEN t IN (34, 36) AND lag(t) {_W}) < 32 THEN 2 END AS k FROM u),
b AS (SELECT *, last_value(k IGNORE NULLS) {_W} {_BEFORE} AS p FROM k)
SELECT user_id, event_id, (count(*) FILTER (k = 2 OR k = 1 AND f AND p = 1) {_W} {_UP})::BIGINT AS au_id FROM b
""",
    "picture_groups": f"""
SELECT user_id, event_id, CASE WHEN t < 32 THEN (count(*) FILTER (t < 32 AND f) {_W} {_UP})::BIGINT - 1 END AS picture_id
FROM (SELECT user_id, ts, event_id, {_UNIT} AS t, event_id % 3 = 0 AS f FROM events)
""",
    "buffered_time": """
WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber * 40.0::DOUBLE AS s, l_linenumber * 40.0::DOUBLE + l_quantity AS e FROM lineitem),
g AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r)
SELECT l_orderkey, round(sum(e - s), 4) AS total, (count(*) FILTER (p IS NULL OR s - p >= 5))::INT AS runs FROM g GROUP BY 1
""",
    "block_levels": """
WITH l AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, embedding FROM embeddings),
r AS (SELECT vec_id, (i - 1)::INT AS i, greatest(-32768, least(32767, floor((floor(embedding[i]::DOUBLE * 3000) * 45 + 4) / 8)))::INT AS residual FROM l)
SELECT *, greatest(0, least(255, 128 + floor(residual / 64)))::INT AS sample FROM r
""",
    "edge_classes": """
WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 20)::INT) AS s, unnest(range(1, len(embedding) - 1)) AS i FROM embeddings)
SELECT vec_id, i::INT AS i, (2 + sign(s[i + 1] - s[i]) + sign(s[i + 1] - s[i + 2]))::INT AS kind FROM l
""",
    "entry_points": """
SELECT p_partkey, i::INT AS i, p_size * i * (i + 1) // 2 AS start FROM (SELECT p_partkey, p_size, unnest(range(p_size % 6 + 1)) AS i FROM part)
""",
    "tile_bounds": """
WITH c AS (SELECT p_partkey, p_size + 7 AS n, p_partkey % 5 + 1 AS k FROM part)
SELECT p_partkey, i::INT AS i, (i + 1) * n // k - i * n // k AS size, i * n // k AS start FROM (SELECT *, unnest(range(k)) AS i FROM c)
""",
    "output_order": f"""
WITH {_SWAPPED}, r AS (SELECT user_id, poc, row_number() OVER (PARTITION BY user_id ORDER BY poc) - 1 AS shown, count(*) OVER (PARTITION BY user_id) AS n FROM s)
SELECT user_id, 0 AS sequence, poc, CASE WHEN shown + 2 < n THEN shown + 2 END AS shown_after, shown FROM r
""",
    "reordered": f"""
WITH {_SWAPPED}, r AS (SELECT user_id, poc, row_number() OVER (PARTITION BY user_id ORDER BY poc) - 1 AS emitted, count(*) OVER (PARTITION BY user_id) AS n FROM s)
SELECT user_id, poc, emitted, emitted + 2 >= n AS flushed FROM r
""",
    "drained_and_flushed": "SELECT event_id, event_type, event_type = 'click' AS flushed FROM events WHERE event_type IN ('view', 'click')",
    "repositions": "SELECT event_id, abs(value / 20 - 1) >= 0.5 AND event_id % 3 > 0 AND event_type <> 'view' AS flush FROM events",
    "queue_served": f"""
WITH q AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'init' WHEN 'error' THEN 'abort' WHEN 'view' THEN NULL ELSE 'segment' END AS kind FROM events),
n AS (SELECT *, (count(*) FILTER (kind = 'abort') {_W} {_UP})::BIGINT AS generation, (count(*) FILTER (kind = 'init') {_W} {_UP})::BIGINT AS init_no, lead(kind) {_W}) AS next FROM q)
SELECT user_id, event_id, generation, init_no, CASE kind WHEN 'init' THEN 'parsed' WHEN 'segment' THEN CASE WHEN next = 'abort' THEN 'dropped' WHEN init_no > 0 THEN 'served' ELSE 'waiting' END END AS state FROM n
""",
    "caps_applied": f"""
WITH {_LADDER}, t AS (SELECT p_partkey, p_brand, p_size AS cap, CASE p_partkey % 4 WHEN 0 THEN 'lower' WHEN 1 THEN 'raise' ELSE 'hold' END AS reason FROM part),
j AS (SELECT t.*, l.height, l.bandwidth, reason <> 'hold' AS change, l.rung IS NOT NULL AS there FROM t LEFT JOIN l ON l.brand = t.p_brand AND l.rung = t.cap)
SELECT p_partkey, reason, change AND there AS apply, change AND NOT there AS reverted, CASE WHEN change THEN height END AS max_height,
       CASE WHEN change THEN bandwidth END AS max_bandwidth, CASE WHEN change THEN ceil(bandwidth / 1000)::BIGINT END AS max_kbps, CASE WHEN change AND there THEN cap END AS level
FROM j
""",
    "caps_by_fold": _SQL["compute_aware_cap"],
}
