"""DuckDB SQL for source_queries."""

from ..sources.annexb import UNIT_NAMES
from .stream_sql import _NUMBERED

_EIGHT = "e AS (SELECT user_id % 8 AS k, event_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS n FROM events)"
_HEADS = "h AS (SELECT DISTINCT user_id % 8 AS k FROM events)"

SQL = {
    "unit_names": f"""
SELECT p_partkey, (p_partkey % 64)::INT AS type, coalesce(name, 'UNKNOWN') AS type_name
FROM part LEFT JOIN (VALUES {", ".join(f"({k}, '{v}')" for k, v in UNIT_NAMES.items())}) t(kind, name) ON kind = p_partkey % 64
""",
    "unescaped_units": """
SELECT event_id, 0 AS nal_idx, 3::BIGINT AS offset, 1 AS type,
       CASE WHEN event_id % 6 <= 3 THEN '1100000' || event_id % 6 || '80' ELSE '110000030' || event_id % 6 || '80' END AS rbsp,
       CASE WHEN event_id % 6 <= 3 THEN 1 ELSE 0 END AS escapes, CASE WHEN event_id % 6 <= 3 THEN 4 ELSE 5 END AS fifth
FROM events
""",
    "manifest_variants": """
WITH p AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS position FROM part)
SELECT 'hls ' || p_brand AS path, position, p_partkey || '.m3u8' AS variant_id, (p_size * 9)::INT AS height, (p_size * 16)::INT AS width, (p_partkey + 1) * 1000 AS bandwidth, 'hvc1.1.6.L90.90,mp4a.40.2' AS codecs FROM p
UNION ALL
SELECT 'dash ' || p_brand, position, p_partkey::VARCHAR, (p_size * 9)::INT, (p_size * 16)::INT, (p_partkey + 1) * 1000, 'hvc1.1.6.L90.90' FROM p
""",
    "init_tracks": """
SELECT p_partkey, 1 AS track, 'vide' AS handler, 'avc1' AS codec, p_partkey % 7 * 1000 + 12800 AS timescale, (p_size * 16)::INT AS width, (p_size * 9)::INT AS height FROM part
UNION ALL SELECT p_partkey, 2, 'soun', 'mp4a', 48000, 0, 0 FROM part WHERE p_partkey % 2 = 0
""",
    "sniffed_segments": """
SELECT p_partkey, k > 0 AND kind IN ('ftyp', 'moov') AS begins_media, k > 0 AND kind = 'ftyp' AS begins_file, '00000008' || hex(CASE WHEN k > 0 THEN kind ELSE 'free' END) AS sent
FROM (SELECT p_partkey, p_partkey % 11 AS k, ['ftyp', 'moov', 'moof', 'free', 'mdat'][p_partkey % 5 + 1] AS kind FROM part)
""",
    "decode_times": f"""
WITH {_NUMBERED}
SELECT stream, (i // 30 + 1)::INT AS sequence, min(i) * 512 + CASE WHEN stream[2]::INT % 2 = 1 THEN 8589934592 ELSE 0 END AS time FROM n GROUP BY stream, i // 30
""",
    "two_track_segments": f"""
WITH {_NUMBERED}
SELECT stream, (i // 20 + 1)::INT AS sequence, 1 AS track, i * 512 AS dts, 512::BIGINT AS duration, i % 10 = 0 AS key, payload FROM n
UNION ALL SELECT stream, (i // 20 + 1)::INT, 2, i // 3 * 1024, 1024, true, payload FROM n WHERE i % 3 = 0
""",
    "parsed_parameter_sets": """
SELECT p_partkey, CASE WHEN ok THEN 0 END AS sps_id, CASE WHEN ok THEN (p_size % 8 * 8)::INT END AS width, CASE WHEN ok THEN (p_size * 8)::INT END AS height,
       CASE WHEN ok THEN 8 END AS log2_max_poc_lsb, CASE WHEN ok THEN 5 END AS max_dpb, NOT ok AS refused
FROM (SELECT *, p_size % 8 > 0 AS ok FROM part)
""",
    "dumped_slices": f"""
WITH {_EIGHT}
SELECT 's' || k AS stream, (n + 1)::INT AS nal_idx, true AS first, 'P' AS slice_type, (30 + k % 4 + event_id % 5 - 2)::INT AS qp, (event_id % 256)::INT AS poc_lsb, false AS refused FROM e
""",
    "dumped_headers": f"""
WITH {_HEADS}
SELECT 's' || k AS stream, 0 AS nal_idx, 0 AS id, 0 AS refers_to, (8 * (k + 1))::VARCHAR AS height, '' AS init_qp FROM h
UNION ALL SELECT 's' || k, 1, 1, 0, '', (30 + k % 4)::VARCHAR FROM h
""",
    "dumped_units": f"""
WITH {_EIGHT}, {_HEADS}
SELECT 's' || k AS stream, (n + 1)::INT AS nal_idx, 1 AS type, 'TRAIL_R' AS type_name, 0 AS tid, n - 1 AS au_id FROM e
UNION ALL SELECT 's' || k, i::INT, CASE i WHEN 0 THEN 33 ELSE 34 END, CASE i WHEN 0 THEN 'SPS_NUT' ELSE 'PPS_NUT' END, 0, 0 FROM h, (SELECT unnest([0, 1]) AS i)
""",
    "long_term_sets": """
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
k AS (SELECT *, n % 8 AS r FROM e)
SELECT user_id, n AS decode_idx, CASE WHEN r > 1 THEN (n - 1)::VARCHAR ELSE '' END AS before,
       CASE WHEN r > 0 THEN (n - r)::VARCHAR ELSE '' END AS long_use, '' AS long_keep, CASE WHEN r > 0 THEN (n - r + 100)::VARCHAR ELSE '' END AS missing
FROM k
""",
}
