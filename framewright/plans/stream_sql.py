"""DuckDB SQL for stream_queries."""

from ..operators.blocks import cosine_matrix
from .media_sql import SQL as _MEDIA, _SETS
from .sql import SQL as _SQL

_NUMBERED = "n AS (SELECT 's' || user_id % 8 AS stream, event_id, event_type || '-' || event_id AS payload, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS i FROM events)"
_ALL = "OVER (ORDER BY ts, event_id"
_UP, _PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SIXTEEN = "e AS (SELECT user_id % 16 AS k, ts, event_id, event_type, value, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) - 1 AS n FROM events)"

_UNITS = f"WITH {_NUMBERED} SELECT stream, i AS nal_idx, (2 + length(payload))::BIGINT AS size, (event_id % 32)::INT AS type, 0 AS layer, 0 AS tid, payload FROM n"

_HELD = f"""
WITH RECURSIVE {_SIXTEEN},
q AS (SELECT k, n, event_type IN ('click', 'purchase') AS done FROM e),
s AS (
  SELECT k, -1::BIGINT AS n, 0 AS busy, 0 AS waiting, 0 AS gone, 0 AS now FROM (SELECT DISTINCT k FROM q)
  UNION ALL
  SELECT k, n, b + out, w - out, gone + out, out FROM (
    SELECT *, greatest(0, least(w, 2 - b)) AS out FROM (
      SELECT s.k, q.n, CASE WHEN q.done THEN greatest(0, s.busy - 1) ELSE s.busy END AS b, s.waiting + CASE WHEN q.done THEN 0 ELSE 1 END AS w, s.gone
      FROM s JOIN q ON q.k = s.k AND q.n = s.n + 1))
),
a AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n) AS place FROM q WHERE NOT done),
last AS (SELECT k, arg_max(busy, n) AS busy FROM s GROUP BY k)
SELECT a.k, a.n, s.n AS released_at, coalesce(s.busy - (s.gone - a.place), last.busy)::INT AS busy
FROM a JOIN last USING (k) LEFT JOIN s ON s.k = a.k AND s.gone >= a.place AND s.gone - s.now < a.place
"""

SQL = {
    "unit_files": _UNITS,
    "unit_files_followed": _UNITS,
    "units_of_types": f"""
WITH {_NUMBERED} SELECT stream, (event_id % 32)::INT AS type, count(*) AS n, sum(2 + length(payload))::BIGINT AS bytes
FROM n WHERE event_id % 32 IN (1, 19, 21) AND stream IN ('s1', 's3') GROUP BY ALL
""",
    "fragment_files": f"WITH {_NUMBERED} SELECT stream, 1 AS track, i * 512 AS dts, i * 512 AS pts, 512::BIGINT AS duration, i % 10 = 0 AS key, payload FROM n",
    "segments_restamped": f"""
WITH {_NUMBERED} SELECT stream, (i // 30 + 1)::INT AS sequence, 90000 + min(i) * 512 AS dts, count(*)::INT AS n FROM n GROUP BY stream, i // 30
""",
    "planar_bytes": """
WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings),
v AS (SELECT vec_id, i, vec_id % 2 = 0 AS one, greatest(0, least(CASE WHEN vec_id % 2 = 0 THEN 255 ELSE 1023 END, floor((x::DOUBLE + 1) * 128 * CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 4 END)))::INT AS y FROM s)
SELECT vec_id, string_agg(CASE WHEN one THEN format('{:02x}', y) ELSE format('{:02x}', y % 256) || format('{:02x}', y // 256) END, '' ORDER BY i) AS yuv FROM v GROUP BY 1
""",
    "hot_sequence_number": f"SELECT event_id, (count(*) FILTER (event_type = 'signup') {_ALL} {_UP})::BIGINT AS seq FROM events",
    "hot_inherit_last": f"SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) {_ALL} {_UP} AS inherited FROM events",
    "hot_counter_unwrap": f"""
WITH a AS (SELECT *, event_id % 16 AS low, event_type = 'signup' AS reset, event_type <> 'click' AS anchor FROM events),
p AS (SELECT *, coalesce(last_value(CASE WHEN reset THEN 0 WHEN anchor THEN low END IGNORE NULLS) {_ALL} {_PAST}, 0) AS prev FROM a),
b AS (SELECT *, CASE WHEN reset THEN 0 WHEN low < prev AND prev - low >= 8 THEN 16 WHEN low > prev AND low - prev > 8 THEN -16 ELSE 0 END AS step FROM p),
t AS (SELECT *, coalesce(sum(CASE WHEN anchor AND NOT reset THEN step ELSE 0 END) {_ALL} {_PAST}, 0) AS total FROM b),
u AS (SELECT *, coalesce(last_value(CASE WHEN reset THEN total END IGNORE NULLS) {_ALL} {_UP}, 0) AS base FROM t)
SELECT event_id, CASE WHEN reset THEN low ELSE total - base + step + low END::BIGINT AS "full" FROM u
""",
    "hot_asof_config": """
SELECT p.event_id, p.value, s.value AS config_value FROM (SELECT *, (ts, event_id) AS at FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT value, (ts, event_id) AS at FROM events WHERE event_type = 'signup') s ON p.at > s.at
""",
    "hot_slice_resolution": f"""
WITH {_SETS}, s AS (SELECT (ts, event_id) AS at, event_id, event_id % 3 AS pps_id FROM events WHERE event_type = 'purchase'),
one AS (SELECT s.*, p.sps_id FROM s ASOF LEFT JOIN (SELECT *, (ts, event_id) AS at FROM pps) p ON p.pps_id = s.pps_id AND s.at > p.at)
SELECT o.event_id, o.pps_id, o.sps_id, q.value AS sps_value FROM one o ASOF LEFT JOIN (SELECT *, (ts, event_id) AS at FROM sps) q ON q.sps_id = o.sps_id AND o.at > q.at
""",
    "stream_reordered": f"""
WITH {_SIXTEEN}, s AS (SELECT k, xor(n, 1) AS poc FROM e),
r AS (SELECT k, poc, row_number() OVER (PARTITION BY k ORDER BY poc) - 1 AS emitted, count(*) OVER (PARTITION BY k) AS n FROM s)
SELECT k, poc, emitted, emitted + 2 >= n AS flushed FROM r
""",
    "stream_caps": _SQL["compute_aware_cap"].replace("SELECT user_id, event_id, coalesce", "SELECT k, n - 1 AS n, coalesce")
    .replace("SELECT user_id, event_id, value / 40 AS speed, row_number() OVER (PARTITION BY user_id ORDER", "SELECT user_id % 16 AS k, event_id, value / 40 AS speed, row_number() OVER (PARTITION BY user_id % 16 ORDER")
    .replace("user_id, 0::BIGINT", "k, 0::BIGINT").replace("DISTINCT user_id", "DISTINCT k").replace("SELECT user_id, n, event_id", "SELECT k, n, event_id")
    .replace("s.user_id", "s.k").replace("e.user_id", "e.k"),
    "stream_init_cache": "SELECT event_id, first_value(event_id) OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts, event_id) AS made_for FROM events",
    "stream_generation": f"""
WITH {_SIXTEEN}, g AS (SELECT k, n, event_id % 1000 AS generation FROM e)
SELECT * FROM g QUALIFY generation >= coalesce(max(generation) OVER (PARTITION BY k ORDER BY n {_PAST}, 0)
""",
    "held_back": _HELD,
    "stream_held_back": _HELD,
    "stream_correlated": _MEDIA["correlated"],
    "observed_totals": """
SELECT *, round(dur::DOUBLE / ms::DOUBLE, 6) AS speed
FROM (SELECT count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS ms, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS dur FROM lineitem)
""",
    "prefixed_units": "SELECT p_partkey, i, CASE i WHEN 0 THEN p_type ELSE p_brand END AS unit FROM part, (SELECT unnest([0, 1])::INT AS i)",
    "stored_parameter_sets": """
SELECT p_partkey, i, CASE i WHEN 0 THEN 33 ELSE 34 END AS type, CASE i WHEN 0 THEN p_type ELSE p_brand END AS unit FROM part, (SELECT unnest([0, 1])::INT AS i)
""",
    "audio_configs": "SELECT p_partkey, p_brand AS config FROM part",
    "table_digests": _MEDIA["digests"],
    "block_transforms": f"""
WITH m AS (SELECT k::INT AS k, j::INT AS j, w FROM (VALUES {", ".join(f"({k},{j},{w})" for k, r in enumerate(cosine_matrix(16)) for j, w in enumerate(r))}) t(k, j, w)),
x AS (SELECT vec_id, unnest(range(16)) AS j, unnest(embedding[1:16]) AS x FROM embeddings),
q AS (SELECT vec_id, j, floor(x::DOUBLE * 1000 + 0.5)::BIGINT AS x FROM x),
y AS (SELECT vec_id, k, sum(x * w)::BIGINT AS y FROM q JOIN m USING (j) GROUP BY ALL),
z AS (SELECT vec_id, j, greatest(-32768, least(32767, (sum((y >> 10) * w)::BIGINT + 64) >> 7)) AS back FROM y JOIN m USING (k) GROUP BY ALL)
SELECT vec_id, k AS i, y, back FROM y JOIN z USING (vec_id) WHERE k = j
""",
}
