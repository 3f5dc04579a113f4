"""DuckDB SQL for the registered queries, written independently: joins where Spark explodes, lists where Spark chains conditions."""

from __future__ import annotations

from ..functions import bins as B
from ..operators.records import TOKEN_METRICS
from ..operators.tokenizing import SPECIAL_TOKENS
from ..settings import DEFAULTS

GAPS = DEFAULTS.gap_sizes
METRICS = ("ADE_km", "FDE_km", "DTW_km", "MAE_km", "MSE_km2")
TEXT_METRICS = ("exact_token_accuracy", "wrong_token_rate", "sequence_exact_match", "invalid_token_rate", "missing_token_rate", "extra_token_rate", "output_length_correct", "MSE_km2", "MAE_km", "ADE_km", "FDE_km", "DTW_km")
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{float(x)}::double" for x in xs) + "]"


def encode(lat: str, lon: str, precision: int = 7) -> str:
    """Cells from bit strings."""
    nx, ny = (5 * precision + 1) // 2, 5 * precision // 2
    bits = lambda v, half, n: f"lpad(bin(least({(1 << n) - 1}, greatest(0, floor(({v} + {half}::double) / {2 * half}::double * {float(1 << n)}::double)))::BIGINT), {n}, '0')"
    x, y = bits(lon, 180.0, nx), bits(lat, 90.0, ny)
    chars = []
    for i in range(precision):
        value = " + ".join(f"{16 >> j} * substr({x if (5 * i + j) % 2 == 0 else y}, {(5 * i + j) // 2 + 1}, 1)::INT" for j in range(5))
        chars.append(f"substr('{ALPHABET}', 1 + {value}, 1)")
    return "(" + " || ".join(chars) + ")"


def decode(cell: str, precision: int = 7) -> tuple[str, str]:
    """(latitude, longitude) of a valid cell's centre."""
    nx, ny = (5 * precision + 1) // 2, 5 * precision // 2
    parts: tuple[list[str], list[str]] = ([], [])
    for b in range(5 * precision):
        axis, place, n = b % 2, b // 2, (nx, ny)[b % 2]
        parts[axis].append(f"(((instr('{ALPHABET}', substr({cell}, {b // 5 + 1}, 1)) - 1) >> {4 - b % 5}) & 1) * {1 << (n - 1 - place)}")
    x, y = (" + ".join(p) for p in parts)
    return f"((({y}) + 0.5::double) * {180.0 / (1 << ny)!r}::double - 90::double)", f"((({x}) + 0.5::double) * {360.0 / (1 << nx)!r}::double - 180::double)"


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(12742::double * asin(sqrt(least(1::double, greatest(0::double, {a})))))"


def speed(bins: B.SpeedBins, sog: str = "SOG") -> str:
    return f"{_list(bins.labels)}[1 + len(list_filter({_list(bins.edges)}, lambda e: e <= {sog}))]"


def course(variant: str, cog: str = "COG") -> str:
    labels = B.cog_labels(variant)
    width = 360.0 / len(labels)
    turn = width / 2 if variant in ("C0", "C1") else 0.0
    return f"{_list(labels)}[1 + floor((({cog} % 360::double + {turn}::double) % 360::double) / {width}::double)::INT]"


_LATP, _LONP = decode("p")
_LATT, _LONT = decode("t")
VALID = "regexp_full_match({0}, '[0-9b-hjkmnp-z]{{7}}')"


def dtw(paths: str) -> str:
    """More common tables, at last warped(id, DTW_km): true DTW of the paths (id, step, pred_lat, pred_lon, true_lat, true_lon)."""
    return f""", route AS ({paths}),
        cost AS (SELECT a.id, a.step, list({km('a.pred_lat', 'a.pred_lon', 'b.true_lat', 'b.true_lon')} ORDER BY b.step) AS c FROM route a JOIN route b USING (id) GROUP BY ALL),
        sums AS (SELECT id, step, list_transform(c, lambda x, j: list_sum(c[1:j])) AS t FROM cost),
        walk AS (SELECT id, step, t AS best FROM sums WHERE step = 0
                 UNION ALL SELECT w.id, n.step, list_transform(n.t, lambda x, j: x + list_min(list_transform(w.best[1:j], lambda y, k: least(y, CASE WHEN k > 1 THEN w.best[k - 1] ELSE y END) - CASE WHEN k > 1 THEN n.t[k - 1] ELSE 0 END)))
                 FROM walk w JOIN sums n ON n.id = w.id AND n.step = w.step + 1),
        warped AS (SELECT id, best[-1] AS DTW_km FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC) = 1)"""


BASE = f"""
WITH RECURSIVE points AS (
  SELECT 'traj_' || lpad((user_id // 3)::VARCHAR, 4, '0') AS trajectory_id, (200000000 + user_id // 3)::BIGINT AS MMSI, ts AS timestamp,
         -60::double + (user_id // 3) % 120 + ((epoch_us(ts) - 1704067200000000)::double / 86400000000::double) * 0.02::double + (event_id % 7) * 0.001::double AS latitude,
         -170::double + ((user_id // 3) * 7) % 340 + ((epoch_us(ts) - 1704067200000000)::double / 86400000000::double) * 0.03::double + (event_id % 11) * 0.001::double AS longitude,
         value / 10::double AS SOG, ((event_id * 7919) % 3700) / 10::double AS COG, user_id // 3 AS v, event_id,
         CASE WHEN (user_id // 3) % 5 IN (0, 1, 2) THEN 'train' WHEN (user_id // 3) % 5 = 3 THEN 'val' ELSE 'test' END AS split
  FROM events
), tok AS (
  SELECT *, {encode('latitude', 'longitude')} AS geohash_7, {speed(B.S1)} AS sog_token, {course('C2')} AS cog_token FROM points
), idx AS (
  SELECT *, row_number() OVER t - 1 AS position, count(*) OVER (PARTITION BY trajectory_id) AS track_length,
         (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER t)) / 60000000::double AS step_min
  FROM tok WINDOW t AS (PARTITION BY trajectory_id ORDER BY timestamp)
), lengths AS (
  SELECT trajectory_id, any_value(split) AS split, count(*) AS n FROM points GROUP BY 1
), gaps AS (SELECT unnest([{', '.join(map(str, GAPS))}]) AS gap_steps
), asked AS (
  SELECT l.*, gap_steps, CASE WHEN split = 'train' THEN 3 ELSE 1 END AS k FROM lengths l, gaps WHERE n >= 120 + gap_steps
), starts AS (
  SELECT DISTINCT trajectory_id, split, gap_steps, k,
         (CASE WHEN k = 1 THEN (n - 120 - gap_steps) // 2 ELSE round_even((n - 120 - gap_steps) * i / 2::double, 0) END)::INT AS start
  FROM asked, range(3) r(i) WHERE i < k
), wins AS (
  SELECT *, trajectory_id || '_gap' || gap_steps || CASE WHEN k > 1 THEN '_w' || (row_number() OVER (PARTITION BY trajectory_id, gap_steps ORDER BY start) - 1) ELSE '' END AS sample_id FROM starts
), win AS (
  SELECT w.sample_id, w.gap_steps::INT AS gap_steps, w.start AS window_start_index, i.*, (i.position - w.start)::INT AS global_row_index,
         CASE WHEN i.position - w.start < 60 THEN 'prefix' WHEN i.position - w.start < 60 + w.gap_steps THEN 'gap' ELSE 'suffix' END AS row_type,
         (CASE WHEN i.position - w.start < 60 THEN i.position - w.start WHEN i.position - w.start < 60 + w.gap_steps THEN i.position - w.start - 60 ELSE i.position - w.start - 60 - w.gap_steps END)::INT AS row_index_in_section,
         CASE WHEN i.position = w.start THEN 0::double ELSE i.step_min END AS dt_min
  FROM wins w JOIN idx i ON i.trajectory_id = w.trajectory_id AND i.position >= w.start AND i.position < w.start + 120 + w.gap_steps
), test_win AS (SELECT * FROM win WHERE split = 'test'
), meta AS (
  SELECT sample_id, trajectory_id, MMSI, split, gap_steps, 60 AS prefix_steps, 60 AS suffix_steps, window_start_index,
         window_start_index + 60 AS gap_start_index, window_start_index + 59 + gap_steps AS gap_end_index, window_start_index + 119 + gap_steps AS window_end_index,
         min(timestamp) FILTER (row_type = 'gap') AS hidden_gap_start_timestamp, max(timestamp) FILTER (row_type = 'gap') AS hidden_gap_end_timestamp,
         max(timestamp) FILTER (row_type = 'prefix') AS last_prefix_timestamp, min(timestamp) FILTER (row_type = 'suffix') AS first_suffix_timestamp,
         round_even((epoch_us(max(timestamp) FILTER (row_type = 'gap')) - epoch_us(min(timestamp) FILTER (row_type = 'gap'))) / 60000000::double, 4) AS hidden_internal_duration_min,
         round_even((epoch_us(min(timestamp) FILTER (row_type = 'suffix')) - epoch_us(max(timestamp) FILTER (row_type = 'prefix'))) / 60000000::double, 4) AS observable_gap_duration_min,
         round_even(max(dt_min) FILTER (global_row_index > 0), 4) AS max_dt_inside_window_min,
         round_even(avg(dt_min) FILTER (global_row_index > 0), 4) AS mean_dt_inside_window_min,
         round_even(quantile_cont(dt_min, 0.5) FILTER (global_row_index > 0), 4) AS median_dt_inside_window_min,
         count(*) FILTER (row_type = 'prefix') AS num_prefix_rows, count(*) FILTER (row_type = 'gap') AS num_gap_rows, count(*) FILTER (row_type = 'suffix') AS num_suffix_rows
  FROM win GROUP BY ALL
), ends AS (
  SELECT sample_id, max(latitude) FILTER (global_row_index = 59) AS lat0, max(longitude) FILTER (global_row_index = 59) AS lon0,
         max(latitude) FILTER (global_row_index = 60 + gap_steps) AS lat1, max(longitude) FILTER (global_row_index = 60 + gap_steps) AS lon1
  FROM win GROUP BY 1
), hidden AS (
  SELECT sample_id, trajectory_id, gap_steps, split, row_index_in_section AS gap_step, latitude, longitude, event_id, v, geohash_7 FROM win WHERE row_type = 'gap'
), known AS (SELECT h.*, lat0, lon0, lat1, lon1, (gap_step + 1) / (gap_steps + 1)::double AS f FROM hidden h JOIN ends USING (sample_id)
), configs(config, scale, shift) AS (VALUES ('x', 1::double, 0), ('y', 0.9::double, 5)
), made(model, p, q, size) AS (VALUES ('a', 17, 29, 0.0004::double), ('b', 31, 43, 0.0006::double)
), steps AS (
  SELECT sample_id, trajectory_id, gap_steps, gap_step, latitude + (((event_id + shift) * p) % 101 - 50) * size * scale AS pred_lat,
         longitude + (((event_id + shift) * q) % 101 - 50) * size * scale AS pred_lon, latitude AS true_lat, longitude AS true_lon, model, config
  FROM hidden, configs, made WHERE split = 'test'
  UNION ALL SELECT sample_id, trajectory_id, gap_steps, gap_step, lat0, lon0, latitude, longitude, 'last_known', config FROM known, configs WHERE split = 'test'
  UNION ALL SELECT sample_id, trajectory_id, gap_steps, gap_step, lat0 + (lat1 - lat0) * f, lon0 + (lon1 - lon0) * f, latitude, longitude, 'linear', config FROM known, configs WHERE split = 'test'
), away AS (SELECT *, {km('true_lat', 'true_lon', 'pred_lat', 'pred_lon')} AS d_km FROM steps
), whole AS (
  SELECT config, model, trajectory_id, sample_id, gap_steps, avg(d_km) AS ADE_km, arg_max(d_km, gap_step) AS FDE_km, sum(d_km) AS DTW_km, avg(d_km) AS MAE_km, avg(d_km * d_km) AS MSE_km2
  FROM away GROUP BY ALL
), sm AS (
  SELECT * REPLACE (CASE WHEN model = 'b' AND substr(trajectory_id, 6)::INT % 10 = 9 THEN NULL ELSE ADE_km END AS ADE_km) FROM whole
), smx AS (SELECT * FROM sm WHERE config = 'x'
), bygap AS (SELECT model, gap_steps, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in METRICS)} FROM smx GROUP BY ALL
), said AS (
  SELECT sample_id, trajectory_id, gap_steps, split, v, list(CASE WHEN gap_step % 7 = 6 THEN 'bad!' WHEN gap_step % 3 = 1 THEN {encode('(latitude + 0.01::double)', 'longitude')} ELSE geohash_7 END ORDER BY gap_step) AS p,
         list(geohash_7 ORDER BY gap_step) AS t
  FROM hidden GROUP BY ALL
), texts AS (
  SELECT sample_id, trajectory_id, gap_steps, split, t, CASE WHEN v % 25 = 24 THEN '' WHEN (v + gap_steps) % 4 = 1 THEN array_to_string(p[1:len(p) - 2], ' ')
         WHEN (v + gap_steps) % 4 = 2 THEN array_to_string(p, ' ') || ' s000000' WHEN (v + gap_steps) % 4 = 3 THEN array_to_string(p, ', ') ELSE array_to_string(p, ' ') END AS predicted
  FROM said
), parsed AS (
  SELECT *, list_filter(regexp_split_to_array(predicted, '[\\s,]+'), lambda x: x <> '') AS raw FROM texts
), fine AS (
  SELECT *, list_filter(raw, lambda x: {VALID.format('x')}) AS ok FROM parsed
), forced AS (
  SELECT *, CASE WHEN len(ok) = 0 THEN list_transform(t, lambda x: 'zzzzzzz') ELSE list_resize(ok, len(t), ok[-1]) END AS fixed FROM fine
), tried AS (
  SELECT 'fixed' AS kind, sample_id, trajectory_id, gap_steps, split, fixed AS p, t FROM forced UNION ALL SELECT 'raw', sample_id, trajectory_id, gap_steps, split, raw, t FROM forced
), pairs AS (
  SELECT kind, sample_id, trajectory_id, gap_steps, split, i - 1 AS step, p[i] AS said_cell, CASE WHEN {VALID.format('p[i]')} THEN p[i] ELSE t[i] END AS p, t[i] AS t
  FROM tried, range(1, 61) r(i) WHERE i <= least(len(p), len(t))
), placed AS (SELECT *, {_LATP} AS pred_lat, {_LONP} AS pred_lon, {_LATT} AS true_lat, {_LONT} AS true_lon FROM pairs
), far AS (SELECT *, {km('true_lat', 'true_lon', 'pred_lat', 'pred_lon')} AS d FROM placed
), path AS (
  SELECT kind, sample_id, avg(d * d) AS MSE_km2, avg(d) AS MAE_km, avg(d) AS ADE_km, arg_max(d, step) AS FDE_km, sum(d) AS diagonal_km, count(*) FILTER (said_cell = t) AS hits FROM far GROUP BY ALL
), scored AS (
  SELECT t.*, len(t.t)::INT AS n_true, len(t.p)::INT AS n_pred, coalesce(hits, 0) / len(t.t)::double AS exact_token_accuracy,
         (least(len(t.p), len(t.t)) - coalesce(hits, 0)) / len(t.t)::double AS wrong_token_rate, (t.p = t.t)::INT AS sequence_exact_match,
         len(list_filter(t.p, lambda x: NOT {VALID.format('x')})) / greatest(len(t.p), 1)::double AS invalid_token_rate,
         greatest(0, len(t.t) - len(t.p)) / len(t.t)::double AS missing_token_rate, greatest(0, len(t.p) - len(t.t)) / len(t.t)::double AS extra_token_rate,
         (len(t.p) = len(t.t))::INT AS output_length_correct, MSE_km2, MAE_km, ADE_km, FDE_km, diagonal_km
  FROM tried t LEFT JOIN path USING (kind, sample_id)
), fx AS (SELECT * FROM scored WHERE kind = 'fixed' AND split = 'test'
), raws AS (SELECT * FROM scored WHERE kind = 'raw' AND split = 'test'
), norm AS (
  SELECT {', '.join(f'avg({c}) AS mean_{c}, stddev_samp({c}) + 1e-8::double AS std_{c}' for c in ('latitude', 'longitude', 'SOG', 'dt_min'))} FROM win WHERE split = 'train' AND row_type <> 'gap'
), feats AS (
  SELECT sample_id, gap_steps, row_type, global_row_index, latitude, longitude, (latitude - mean_latitude) / std_latitude AS sl, (longitude - mean_longitude) / std_longitude AS so,
         CASE WHEN row_type = 'gap' THEN 0 ELSE (latitude - mean_latitude) / std_latitude END::FLOAT AS f0, CASE WHEN row_type = 'gap' THEN 0 ELSE (longitude - mean_longitude) / std_longitude END::FLOAT AS f1,
         CASE WHEN row_type = 'gap' THEN 0 ELSE (SOG - mean_SOG) / std_SOG END::FLOAT AS f2, CASE WHEN row_type = 'gap' THEN 0 ELSE sin(radians(COG % 360::double)) END::FLOAT AS f3,
         CASE WHEN row_type = 'gap' THEN 0 ELSE cos(radians(COG % 360::double)) END::FLOAT AS f4, ((dt_min - mean_dt_min) / std_dt_min)::FLOAT AS f5, CASE WHEN row_type = 'gap' THEN 0 ELSE 1 END::FLOAT AS f6
  FROM win, norm
), tmeta AS (SELECT * FROM meta WHERE split = 'test'
), behave AS (
  SELECT a.sample_id, a.gap_steps, a.ADE_km, a.FDE_km, observable_gap_duration_min, mean_dt_inside_window_min, hidden_internal_duration_min, max_dt_inside_window_min,
         b.ADE_km AS base_ADE_km, b.FDE_km AS base_FDE_km, coalesce(a.ADE_km < b.ADE_km, false) AS wins, mean_dt_inside_window_min < 150 AS fast_sampling
  FROM smx a JOIN smx b USING (sample_id, gap_steps) JOIN tmeta m USING (sample_id, gap_steps) WHERE a.model = 'b' AND b.model = 'linear'
), longm AS (UNPIVOT sm ON {', '.join(METRICS)} INTO NAME metric VALUE value
), duels AS (
  SELECT a.config, a.gap_steps, a.sample_id, b.model AS baseline, m.metric, m.mine, m.base FROM sm a JOIN sm b USING (config, gap_steps, sample_id),
         LATERAL (VALUES {', '.join(f"('{c}', a.{c}, b.{c})" for c in METRICS)}) m(metric, mine, base) WHERE a.model = 'a' AND b.model <> 'a'
)
""".replace(f"), longm AS (UNPIVOT sm ON {', '.join(METRICS)} INTO NAME metric VALUE value\n", "")


def _round(names, digits=6, how="round") -> str:
    """Columns by name, or expressions by name."""
    of = names if isinstance(names, dict) else {c: c for c in names}
    return ", ".join(f"{how}({e}, {digits}) AS {c}" for c, e in of.items())


def _wins(source: str, keys: str, mine: str = "mine", base: str = "base") -> str:
    share = f"100::double * count(*) FILTER ({mine} < {base}) / count(*)"
    return f"SELECT {keys}, count(*) FILTER ({mine} < {base}) AS wins, count(*) AS total, round_even({share}, 1) AS win_percent FROM {source} GROUP BY ALL"


def _quantile_sog(variant: str) -> str:
    n = B.QUANTILE_BINS[variant]
    labels = B.quantile_bins(variant, [10.0 + i for i in range(n - 1)]).labels
    cuts = f"(SELECT quantile_cont(SOG, [{', '.join(f'{i}/{n}::double' for i in range(1, n))}]) FROM points WHERE split = 'train' AND SOG >= 4)"
    return f"SELECT event_id, {_list(labels)}[1 + len(list_filter(list_concat({_list(B.FIXED_EDGES)}, {cuts}), lambda e: e <= SOG))] AS token FROM points"


STEP_COLUMNS = "sample_id, trajectory_id, gap_steps, gap_step"
PLACES = ("pred_lat", "pred_lon", "true_lat", "true_lon")

_TEXT_DTW = dtw("SELECT kind || '/' || sample_id AS id, step, pred_lat, pred_lon, true_lat, true_lon FROM placed WHERE split = 'test'")

_TRUE = (
    dtw("SELECT config || '/' || model || '/' || sample_id AS id, gap_step AS step, pred_lat, pred_lon, true_lat, true_lon FROM steps")
    + f""", tsm AS (SELECT sm.* EXCLUDE (DTW_km), warped.DTW_km FROM sm JOIN warped ON id = config || '/' || model || '/' || sample_id),
        tgap AS (SELECT config, model, gap_steps, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in METRICS)} FROM tsm GROUP BY ALL),
        tall AS (SELECT config, model, {', '.join(f'avg({c}) AS {c}' for c in METRICS)} FROM tgap GROUP BY ALL),
        tlong AS (SELECT config, model, gap_steps::VARCHAR AS gap, {', '.join(METRICS)} FROM tgap UNION ALL SELECT config, model, 'overall', {', '.join(METRICS)} FROM tall)
        """
)

SELECTS = {
    "read_points": "SELECT trajectory_id, MMSI, timestamp, latitude, longitude, SOG, COG FROM points",
    "read_table_csv": "SELECT DISTINCT trajectory_id, split FROM points",
    "write_table_csv": f"SELECT {STEP_COLUMNS}, {_round(PLACES)}, model, config FROM steps",
    "read_sft_jsonl": "SELECT sample_id, trajectory_id, gap_steps, array_to_string(t, ' ') AS answer FROM said",
    "write_gap_examples": "SELECT split, gap_steps, sample_id, global_row_index, row_type, geohash_7 FROM win",
    "read_metrics_json": f"{_TRUE} SELECT model, gap, {_round(METRICS)} FROM tlong WHERE model = 'linear' AND config = 'x'",
    "write_metrics_json": f"{_TRUE} SELECT config || '/' || model AS model, gap, {_round(METRICS)} FROM tlong",
    "gap_examples_by_track": "SELECT trajectory_id, count(*) AS n_rows, count(DISTINCT sample_id) AS n_samples FROM win GROUP BY 1",
    "read_table_csv_checked": """SELECT CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'violation' ELSE 'row' END AS kind,
        CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN event_id || ',' || CASE WHEN event_id % 7 = 0 THEN 'fast' ELSE floor(SOG)::BIGINT::VARCHAR END || CASE WHEN event_id % 11 = 0 THEN ',more' ELSE '' END ELSE event_id::VARCHAR END AS record FROM points""",
    "read_sft_jsonl_checked": """, k AS (SELECT CASE WHEN gap_steps = 45 OR MMSI % 7 = 3 THEN 'violation' ELSE 'row' END AS kind,
        CASE WHEN gap_steps = 45 THEN substr('{"sample_id":"' || sample_id, 1, 20) WHEN MMSI % 7 = 3 THEN '{"sample_id":"' || sample_id || '","gap_steps":"many"}' ELSE sample_id END AS record FROM meta)
        SELECT kind, count(*) AS n, min(record) AS first_record FROM k GROUP BY 1""",
    "read_points_checked": """SELECT trajectory_id, '' AS column_name, count(*) AS n FROM points WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 GROUP BY 1
        UNION ALL SELECT '', 'timestamp', count(*) FROM points WHERE event_id % 13 = 0 UNION ALL SELECT '', 'SOG', count(*) FROM points WHERE event_id % 17 = 0""",
    "points_of_split": "SELECT event_id, trajectory_id, split FROM points WHERE split = 'test'",
    "check_schema": "SELECT * FROM (VALUES ('MMSI', 'bigint', 'string'), ('SOG', 'double', NULL)) t(column_name, wanted, found)",
    "check_nulls": "SELECT 'trajectory_id' AS column_name, count(*) FILTER (trajectory_id IS NULL) AS n_nulls FROM points UNION ALL SELECT 'timestamp', count(*) FILTER (timestamp IS NULL) FROM points UNION ALL SELECT 'SOG', count(*) FILTER (SOG IS NULL OR event_id % 50 IN (0, 1)) FROM points UNION ALL SELECT 'COG', count(*) FILTER (COG IS NULL) FROM points",
    "check_timestamps": "SELECT event_id, 'no time' AS timestamp FROM points WHERE event_id % 97 = 0",
    "check_coordinates": "SELECT count(*) FILTER (latitude NOT BETWEEN -30 AND 30) AS bad_latitude, count(*) FILTER (longitude NOT BETWEEN -120 AND 120) AS bad_longitude FROM points",
    "check_sog_cog": "SELECT count(*) FILTER (event_id % 40 = 0) AS null_sog, count(*) FILTER (event_id % 40 <> 0 AND SOG - 0.5::double < 0) AS bad_sog, count(*) FILTER (COG IS NULL) AS null_cog, count(*) FILTER (COG < 0 OR COG > 360) AS bad_cog FROM points",
    "check_integrity": """, p AS (SELECT trajectory_id, event_id, CASE WHEN v % 7 = 3 THEN date_trunc('day', timestamp) ELSE timestamp END AS moment FROM points)
        SELECT trajectory_id, 'repeated_timestamp' AS reason FROM p GROUP BY 1 HAVING count(DISTINCT moment) < count(*)
        UNION ALL SELECT trajectory_id, 'too_few_points' FROM p GROUP BY 1 HAVING count(*) < 2
        UNION ALL SELECT DISTINCT trajectory_id, 'not_increasing' FROM (SELECT *, lag(moment) OVER (PARTITION BY trajectory_id ORDER BY event_id) AS before FROM p) WHERE moment <= before
        UNION ALL SELECT NULL, 'number_of_tracks' FROM p HAVING count(DISTINCT trajectory_id) <> 1000""",
    "check_tokens": "SELECT DISTINCT 'odd' || (v % 8) AS token FROM points WHERE event_id % 9 = 0 ORDER BY 1 LIMIT 5",
    "check_splits": """, s AS (SELECT DISTINCT trajectory_id, split FROM points), a AS (SELECT * FROM s UNION ALL SELECT trajectory_id, 'val' FROM s WHERE trajectory_id LIKE '%3' UNION ALL SELECT * FROM s WHERE trajectory_id LIKE '%1')
        SELECT trajectory_id AS subject, 'several_splits' AS reason FROM a GROUP BY 1 HAVING count(DISTINCT split) > 1
        UNION ALL SELECT trajectory_id, 'listed_twice' FROM a GROUP BY 1 HAVING count(*) > count(DISTINCT split)
        UNION ALL SELECT split, 'split_size' FROM a GROUP BY 1 HAVING count(DISTINCT trajectory_id) <> CASE split WHEN 'train' THEN 800 ELSE 100 END""",
    "check_unassigned": "SELECT trajectory_id, count(*) AS n_points FROM points WHERE split = 'val' GROUP BY 1",
    "check_samples": """ SELECT sample_id, unnest(CASE r WHEN 4 THEN CASE WHEN gap_steps <= 10 THEN ['window_length', 'suffix_length', 'not_contiguous'] ELSE ['window_length', 'gap_length', 'not_contiguous'] END
               WHEN 9 THEN ['null_token'] WHEN 14 THEN ['invalid_token'] WHEN 19 THEN ['not_increasing'] WHEN 24 THEN ['null_timestamp'] END) AS reason
        FROM (SELECT DISTINCT sample_id, gap_steps, v % 25 AS r FROM win)""",
    "input_counts": "SELECT count(*) AS n_rows, count(DISTINCT trajectory_id) AS n_tracks, min(SOG) AS min_sog, max(SOG) AS max_sog, min(COG) AS min_cog, max(COG) AS max_cog FROM points",
    "interval_stats": "SELECT round(min(step_min), 6) AS min_minutes, round(avg(step_min), 6) AS mean_minutes, round(quantile_cont(step_min, 0.5), 6) AS median_minutes, round(max(step_min), 6) AS max_minutes FROM idx WHERE step_min IS NOT NULL",
    "length_stats": "SELECT min(n) AS min_points, max(n) AS max_points, round(avg(n), 6) AS mean_points, round(quantile_cont(n, 0.5)::double, 6) AS median_points FROM lengths",
    "token_distribution": ", u AS (SELECT 'sog' AS kind, sog_token AS token FROM tok UNION ALL SELECT 'cog', cog_token FROM tok), c AS (SELECT kind, token, count(*) AS n FROM u GROUP BY ALL) SELECT kind, token, n, round(100::double * n / (SELECT count(*) FROM points), 6) AS percent, 100::double * n / (SELECT count(*) FROM points) < 0.5 AS rare FROM c",
    "geohash_encode": f"SELECT event_id, geohash_7 AS cell, {encode('latitude', 'longitude', 5)} AS cell_5 FROM tok",
    "geohash_valid": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN NOT regexp_matches(geohash_7, '[a-z]') WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS valid FROM tok",
    "geohash_decode": "SELECT event_id, round({0}, 6) AS lat, round({1}, 6) AS lon FROM tok".format(*decode("geohash_7")),
    "sog_token_s0": f"SELECT event_id, {speed(B.S0)} AS token FROM points",
    "sog_token_s1": "SELECT event_id, sog_token AS token FROM tok",
    "sog_token_s2": _quantile_sog("S2"),
    "sog_token_s3": _quantile_sog("S3"),
    **{f"cog_token_{c.lower()}": f"SELECT event_id, {course(c)} AS token FROM points" for c in ("C0", "C1", "C2", "C3")},
    "fit_sog_quantiles": f"SELECT unnest(range(1, 12)) AS bin, round(unnest(quantile_cont(SOG, [{', '.join(f'{i}/12::double' for i in range(1, 12))}])), 6) AS cut FROM points WHERE split = 'train' AND SOG >= 4",
    "cog_normalize": "SELECT event_id, CASE WHEN COG - 30 < 0 THEN (COG - 30::double + 360::double) % 360::double ELSE (COG - 30::double) % 360::double END AS cog FROM points",
    "token_vocabulary": f", voc AS (SELECT 'sog' AS kind, unnest({_list(B.S1.labels)}) AS token UNION ALL SELECT 'cog', unnest({_list(B.cog_labels('C2'))}) UNION ALL SELECT 'special', unnest({_list(SPECIAL_TOKENS)})) SELECT kind, token, (SELECT count(*) FROM tok WHERE sog_token = token OR cog_token = token) AS n FROM voc",
    "tokenize": "SELECT event_id, geohash_7, sog_token, cog_token FROM tok",
    "distinct_tracks": "SELECT DISTINCT trajectory_id FROM points",
    "split_exact": ", r AS (SELECT trajectory_id, row_number() OVER (ORDER BY md5('42:' || trajectory_id), trajectory_id) AS k, count(*) OVER () AS n FROM lengths) SELECT trajectory_id, CASE WHEN k <= n * 8 // 10 THEN 'train' WHEN k <= n * 8 // 10 + n // 10 THEN 'val' ELSE 'test' END AS split FROM r",
    "attach_split": "SELECT event_id, trajectory_id, split FROM points",
    "split_counts": "SELECT split, count(*) AS n_tracks FROM lengths GROUP BY 1",
    "filter_split": "SELECT event_id, trajectory_id FROM points WHERE split = 'val'",
    "track_index": "SELECT event_id, trajectory_id, position::INT AS position, track_length::INT AS track_length, MMSI FROM idx",
    "track_index_blocks": "SELECT event_id, trajectory_id, position::INT AS position, track_length::INT AS track_length, MMSI, round(step_min, 6) AS step_min FROM idx",
    "gap_windows_blocks": "SELECT sample_id, split, gap_steps, event_id, global_row_index, row_type, round(dt_min, 6) AS dt_min FROM win",
    "window_starts": """, w AS (SELECT trajectory_id, gap_steps::INT AS gap_steps, k::INT AS asked, n - 120 - gap_steps AS room FROM lengths, gaps, (VALUES (1), (3), (4)) t(k)),
        s AS (SELECT DISTINCT trajectory_id, gap_steps, asked, CASE WHEN asked = 1 THEN room // 2 ELSE round_even(room * i / (asked - 1)::double, 0)::INT END AS start FROM w, range(4) r(i) WHERE room >= 0 AND i < asked)
        SELECT w.trajectory_id, w.gap_steps, w.asked, coalesce(string_agg(start::VARCHAR, ',' ORDER BY start), '') AS starts FROM w LEFT JOIN s USING (trajectory_id, gap_steps, asked) GROUP BY ALL""",
    "gap_windows": "SELECT sample_id, split, gap_steps, event_id, global_row_index FROM win",
    "row_sections": "SELECT sample_id, global_row_index, row_type, row_index_in_section FROM win",
    "dt_min": "SELECT sample_id, global_row_index, round(dt_min, 6) AS dt_min FROM win",
    "sample_id": "SELECT sample_id, trajectory_id, gap_steps::INT AS gap_steps, start AS window_start_index FROM wins",
    "gap_metadata": "SELECT * FROM meta",
    "window_outcomes": "SELECT gap_steps::INT AS gap_steps, (SELECT count(*) FROM wins w WHERE w.gap_steps = g.gap_steps) AS created, (SELECT count(*) FROM lengths WHERE n < 120 + g.gap_steps) AS skipped FROM gaps g",
    "sample_counts": "SELECT coalesce(split, 'all') AS split, count(*) AS n_samples FROM wins GROUP BY ROLLUP (split)",
    "sft_records": f"""SELECT w.sample_id, w.trajectory_id, w.gap_steps, 'system' AS first_role,
        'PREFIX: ' || string_agg(geohash_7 || ' ' || sog_token || ' ' || cog_token || ' ' || printf('%.1f', round(dt_min, 1)), '; ' ORDER BY global_row_index) FILTER (row_type = 'prefix') || chr(10) || 'HIDDEN STEPS: ' || w.gap_steps || chr(10) ||
        'SUFFIX: ' || string_agg(geohash_7 || ' ' || sog_token || ' ' || cog_token || ' ' || printf('%.1f', round(dt_min, 1)), '; ' ORDER BY global_row_index) FILTER (row_type = 'suffix') AS user,
        string_agg(geohash_7, ' ' ORDER BY global_row_index) FILTER (row_type = 'gap') AS answer FROM win w GROUP BY w.sample_id, w.trajectory_id, w.gap_steps""",
    "truth_tokens": "SELECT sample_id, len(t)::INT AS n, t[-1] AS last_token FROM said",
    "parse_tokens": "SELECT sample_id, len(raw)::INT AS n, array_to_string(raw, '|') AS tokens FROM parsed",
    "constrain_n": "SELECT sample_id, array_to_string(fixed, ' ') AS tokens FROM forced",
    "raw_length_ok": "SELECT sample_id, len(raw) = len(t) AS raw_length_ok FROM parsed",
    "token_metrics": f"SELECT sample_id, {_round([c for c in TOKEN_METRICS if c.endswith(('rate', 'accuracy'))])}, sequence_exact_match, output_length_correct, n_true, n_pred FROM scored WHERE kind = 'raw'",
    "token_spatial_metrics": f"""{_TEXT_DTW} SELECT sample_id, {_round(('MSE_km2', 'MAE_km', 'ADE_km', 'FDE_km', 'diagonal_km', 'DTW_km'))} FROM raws LEFT JOIN warped ON id = 'raw/' || sample_id""",
    "token_steps": f"SELECT sample_id, trajectory_id, gap_steps, step::INT AS gap_step, {_round(PLACES)} FROM placed WHERE kind = 'fixed'",
    "per_step_accuracy": ", g AS (SELECT DISTINCT gap_steps FROM texts), s AS (SELECT gap_steps, i::INT AS step FROM g, range(60) r(i) WHERE i < gap_steps) SELECT s.gap_steps, s.step, round(count(*) FILTER (said_cell = t) / nullif(count(t), 0)::double, 6) AS accuracy, count(t) AS n FROM s LEFT JOIN (SELECT * FROM pairs WHERE kind = 'raw') p ON p.gap_steps = s.gap_steps AND p.step = s.step GROUP BY ALL",
    "prediction_table": f"""{_TEXT_DTW} SELECT sample_id, trajectory_id, gap_steps, array_to_string(p, ' ') AS predicted, array_to_string(t, ' ') AS true, n_true, n_pred, {_round(('exact_token_accuracy', 'ADE_km', 'FDE_km', 'DTW_km', 'MAE_km', 'MSE_km2'))}, sequence_exact_match FROM fx LEFT JOIN warped ON id = 'fixed/' || sample_id""",
    "haversine_km": f"SELECT event_id, round({km('latitude', 'longitude', '(latitude + SOG / 10)', '(-longitude)')}, 6) AS km FROM points",
    "to_enu_m": "SELECT event_id, round(radians(longitude - (longitude + COG / 1000)) * 6371000::double * cos(radians((latitude + (latitude - 0.25::double)) / 2)), 6) AS east_m, round(radians(latitude - (latitude - 0.25::double)) * 6371000::double, 6) AS north_m FROM points",
    "from_enu_m": "SELECT event_id, round(latitude + degrees(COG * 10 / 6371000::double), 6) AS lat, round(longitude + degrees(SOG * 100 / (6371000::double * cos(radians(latitude + degrees(COG * 10 / 6371000::double) / 2)))), 6) AS lon FROM points",
    "step_distances": "SELECT config, model, sample_id, gap_step, round(d_km, 6) AS d_km FROM away",
    **{k: f"SELECT config, model, sample_id, round({c}, 6) AS {c} FROM whole" for k, c in (("mse_km2", "MSE_km2"), ("mae_km", "MAE_km"), ("ade_km", "ADE_km"), ("fde_km", "FDE_km"))},
    "diagonal_sum_km": "SELECT config, model, sample_id, round(DTW_km, 6) AS diagonal_km FROM whole",
    "dtw_km": f"""{dtw("SELECT config || '/' || model || '/' || sample_id AS id, gap_step AS step, pred_lat, pred_lon, true_lat, true_lon FROM steps")}
        SELECT split_part(id, '/', 1) AS config, split_part(id, '/', 2) AS model, split_part(id, '/', 3) AS sample_id, round(DTW_km, 6) AS DTW_km FROM warped""",
    "sample_metrics": f"SELECT config, model, trajectory_id, sample_id, gap_steps, {_round(METRICS)} FROM whole",
    "complete_samples": "SELECT sample_id, CASE WHEN any_value(v) % 10 = 4 THEN 0 ELSE count(*) END AS n_rows FROM win GROUP BY 1",
    "fill_last_known": f"SELECT {STEP_COLUMNS}, {_round({'pred_lat': 'lat0', 'pred_lon': 'lon0', 'true_lat': 'latitude', 'true_lon': 'longitude'})} FROM known",
    "fill_linear": f"SELECT {STEP_COLUMNS}, {_round({'pred_lat': 'lat0 + (lat1 - lat0) * f', 'pred_lon': 'lon0 + (lon1 - lon0) * f', 'true_lat': 'latitude', 'true_lon': 'longitude'})} FROM known",
    "step_predictions": f"SELECT config, model, {STEP_COLUMNS}, {_round(PLACES)} FROM steps WHERE model IN ('a', 'b')",
    "norm_stats": f"SELECT {_round([f'{k}_{c}' for c in ('latitude', 'longitude', 'SOG', 'dt_min') for k in ('mean', 'std')])} FROM norm",
    "feature_rows": f"SELECT sample_id, global_row_index, {', '.join(f'round(f{i}::double, 3) AS f{i}' for i in range(7))} FROM feats",
    "feature_sequences": "SELECT sample_id, count(*)::INT AS n_inputs, (count(*) FILTER (row_type = 'gap'))::INT AS n_target, round(sum(f0::double + f1::double + f2::double + f3::double + f4::double + f5::double + f6::double), 2) AS input_sum, round(sum(sl::FLOAT::double + so::FLOAT::double) FILTER (row_type = 'gap'), 2) AS target_sum, (count(*) FILTER (row_type = 'prefix'))::INT AS n_prefix FROM feats GROUP BY 1",
    "denormalize": "SELECT sample_id, global_row_index, round(latitude, 6) AS pred_lat, round(longitude, 6) AS pred_lon FROM feats WHERE row_type = 'gap'",
    "metrics_by_gap": f"""{_TEXT_DTW} SELECT gap_steps, count(*) AS num_examples, {', '.join(f'round(avg({c}), 6) AS {c}' for c in TEXT_METRICS)}, 'S1' AS sog_variant, 'C2' AS cog_variant FROM fx LEFT JOIN warped ON id = 'fixed/' || sample_id GROUP BY gap_steps""",
    "metrics_with_overall": f"""{_TEXT_DTW} SELECT CASE WHEN grouping(gap_steps) = 1 THEN 'overall' ELSE 'gap_' || gap_steps END AS gap, count(*) AS num_examples, {', '.join(f'round(avg({c}), 6) AS {c}' for c in TEXT_METRICS)} FROM fx LEFT JOIN warped ON id = 'fixed/' || sample_id GROUP BY GROUPING SETS ((gap_steps), ())""",
    "spatial_by_gap": f"{_TRUE} SELECT config, model, gap_steps, n, {_round(METRICS)} FROM tgap",
    "macro_overall": f"{_TRUE} SELECT config, model, {_round(METRICS)} FROM tall",
    "model_gap_table": f"SELECT config, gap_steps, model, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in METRICS)}, gap_steps * 10 AS gap_minutes FROM sm GROUP BY config, gap_steps, model",
    "comparison_wide": f"{_TRUE} SELECT b.config, b.model, {', '.join(f'round(max(b.{c}) FILTER (gap_steps = {g}), 6) AS gap_{g}_{c}' for g in GAPS for c in METRICS)}, {', '.join(f'round(any_value(m.{c}), 6) AS overall_{c}' for c in METRICS)} FROM tgap b JOIN tall m USING (config, model) GROUP BY b.config, b.model",
    "comparison_long": f"{_TRUE} SELECT config, model, gap, {_round(METRICS)} FROM tlong",
    "best_model": _TRUE + "SELECT config, gap, model FROM tlong WHERE ADE_km IS NOT NULL QUALIFY row_number() OVER (PARTITION BY config, gap ORDER BY ADE_km, model) = 1",
    "win_rate": _wins("(SELECT a.config, a.gap_steps, a.ADE_km AS mine, b.ADE_km AS base FROM sm a JOIN sm b USING (config, gap_steps, sample_id) WHERE a.model = 'b' AND b.model = 'linear')", "config, gap_steps"),
    "win_rate_table": _wins("duels", "config, gap_steps, baseline, metric"),
    "win_rates_from_files": _wins("duels", "config, gap_steps, baseline, metric"),
    "win_rate_pivot": ", w AS (" + _wins("(SELECT * FROM duels WHERE metric = 'ADE_km')", "config, gap_steps, baseline") + f") SELECT config, baseline, {', '.join(f'max(win_percent) FILTER (gap_steps = {g}) AS gap_{g}' for g in GAPS)} FROM w GROUP BY ALL",
    "config_win_rate": _wins("(SELECT a.gap_steps, a.ADE_km AS mine, b.ADE_km AS base FROM sm a JOIN sm b USING (gap_steps, sample_id, model) WHERE a.model = 'b' AND a.config = 'y' AND b.config = 'x')", "gap_steps"),
    "gap_duration_stats": "SELECT gap_steps, round(avg(observable_gap_duration_min), 6) AS mean_gap_min, round(min(observable_gap_duration_min), 6) AS min_gap_min, round(max(observable_gap_duration_min), 6) AS max_gap_min, round(avg(mean_dt_inside_window_min), 6) AS mean_dt_min, round(stddev_samp(mean_dt_inside_window_min), 6) AS std_dt_min FROM meta GROUP BY 1",
    "behaviour_join": f"SELECT sample_id, gap_steps, {_round(('ADE_km', 'FDE_km', 'observable_gap_duration_min', 'mean_dt_inside_window_min', 'hidden_internal_duration_min', 'max_dt_inside_window_min', 'base_ADE_km', 'base_FDE_km'))}, wins, fast_sampling FROM behave",
    "win_by_sampling": ", k AS (SELECT gap_steps, 'all' AS sampling, wins FROM behave UNION ALL SELECT gap_steps, CASE WHEN fast_sampling THEN 'fast' ELSE 'slow' END, wins FROM behave) SELECT gap_steps, sampling, round(100::double * count(*) FILTER (wins) / count(*), 6) AS win_percent, count(*) FILTER (wins) AS wins, count(*) AS n FROM k GROUP BY gap_steps, sampling",
    "win_by_duration_quartile": """, q AS (SELECT quantile_cont(observable_gap_duration_min, [0.25, 0.5, 0.75]) AS e FROM behave), b AS (SELECT gap_steps, wins, 1 + len(list_filter(e, lambda x: x < observable_gap_duration_min)) AS quartile FROM behave, q)
        SELECT g.gap_steps, g.quartile::INT AS quartile, round_even(100::double * count(*) FILTER (wins) / nullif(count(wins), 0), 1) AS win_percent, count(wins) AS n FROM (SELECT DISTINCT gap_steps, unnest([1, 2, 3, 4]) AS quartile FROM behave) g LEFT JOIN b USING (gap_steps, quartile) GROUP BY ALL""",
    "full_summary": f"SELECT gap_steps, gap_steps * 10 AS gap_minutes, config, model, count(*) AS n, {', '.join(f'round_even(avg({c}), 3) AS {c}' for c in METRICS)} FROM sm GROUP BY config, gap_steps, model",
    "token_accuracy_summary": f"SELECT CASE kind WHEN 'fixed' THEN 'x' ELSE 'y' END AS config, {', '.join(f'round(avg({c}) FILTER (gap_steps = {g}), 6) AS gap_{g}_{n}' for g in GAPS for n, c in (('accuracy', 'exact_token_accuracy'), ('exact', 'sequence_exact_match')))} FROM scored WHERE split = 'test' GROUP BY kind",
    "sized_subset_table": ", w AS (" + _wins("(SELECT * FROM duels WHERE metric = 'ADE_km' AND gap_steps IN (30, 45))", "config, gap_steps, baseline") + """), m AS (
        SELECT config, gap_steps, model, count(*) AS n, round(avg(ADE_km), 6) AS ADE_km, round(avg(FDE_km), 6) AS FDE_km, round(avg(DTW_km), 6) AS DTW_km FROM sm WHERE gap_steps IN (30, 45) GROUP BY ALL)
        SELECT m.*, wins, total, win_percent FROM m LEFT JOIN w ON w.config = m.config AND w.gap_steps = m.gap_steps AND w.baseline = m.model""",
    "metric_distribution": """, q AS (SELECT config, gap_steps, model, count(ADE_km) AS n, min(ADE_km) AS min, quantile_cont(ADE_km, 0.25) AS q1, quantile_cont(ADE_km, 0.5) AS median, quantile_cont(ADE_km, 0.75) AS q3, max(ADE_km) AS max FROM sm GROUP BY ALL)
        SELECT q.config, q.gap_steps, q.model, any_value(n) AS n, round(any_value(q.min), 6) AS min, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(any_value(q.max), 6) AS max,
               round(min(ADE_km), 6) AS whisker_low, round(max(ADE_km), 6) AS whisker_high FROM q JOIN sm USING (config, gap_steps, model) WHERE ADE_km BETWEEN q1 - 1.5::double * (q3 - q1) AND q3 + 1.5::double * (q3 - q1) GROUP BY q.config, q.gap_steps, q.model""",
    "paired_metric": ", p AS (SELECT a.gap_steps, a.sample_id, a.ADE_km AS first, b.ADE_km AS second, coalesce(b.ADE_km < a.ADE_km, false) AS second_better FROM sm a JOIN sm b USING (gap_steps, sample_id, model) WHERE a.model = 'b' AND a.config = 'x' AND b.config = 'y') SELECT gap_steps, sample_id, round(first, 6) AS first, round(second, 6) AS second, second_better, count(*) FILTER (second_better) OVER (PARTITION BY gap_steps) AS n_second_better FROM p",
    "step_alignment": f""", k AS (SELECT * FROM steps WHERE trajectory_id NOT LIKE '%9'), e AS (SELECT sample_id, arg_min(true_lat, gap_step) AS start_lat, arg_min(true_lon, gap_step) AS start_lon, arg_max(true_lat, gap_step) AS end_lat, arg_max(true_lon, gap_step) AS end_lon FROM k WHERE model = 'a' AND config = 'x' GROUP BY 1)
        SELECT config, sample_id, gap_steps, gap_step, round(any_value(true_lat), 6) AS true_lat, round(any_value(true_lon), 6) AS true_lon, {', '.join(f"round(max(pred_{c}) FILTER (model = '{m}'), 6) AS {m}_{c}" for m in ('linear', 'a', 'b') for c in ('lat', 'lon'))},
               {', '.join(f'round(any_value({n}), 6) AS {n}' for n in ('start_lat', 'start_lon', 'end_lat', 'end_lon'))} FROM k JOIN e USING (sample_id) GROUP BY ALL""",
    "first_k_samples": "SELECT DISTINCT gap_steps, sample_id FROM sm QUALIFY dense_rank() OVER (PARTITION BY gap_steps ORDER BY sample_id) <= 3",
    "gap_filter": "SELECT config, model, sample_id, gap_steps FROM sm WHERE gap_steps IN (5, 10, 30, 45)",
    "straight_line_error": f"SELECT model, gap_steps, n, {_round(METRICS)} FROM bygap WHERE model = 'linear'",
}


def oracle_sql() -> dict[str, str]:
    return {name: BASE + sql for name, sql in SELECTS.items()}
