"""SQL twins of the registered queries, over the given tables.

They are written apart from the operators: plain subqueries and windows, with
policy tables as VALUES.
"""

from __future__ import annotations

from plantlens import policy as P
from plantlens.sources.adapters import STATEMENTS

_BASE = f"""
ev AS (SELECT * FROM inspections QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1),
fp AS (SELECT *, CAST(ts AS DATE) AS d, CASE WHEN vision_result = 'FAIL' THEN 1 ELSE 0 END AS bad FROM ev WHERE inspection_pass = 1),
daily AS (SELECT station_id, d, min(line_id) AS line_id, count(*) AS n, CAST(sum(bad) AS BIGINT) AS fails, sum(bad) * CAST(1 AS DOUBLE) / count(*) AS rate FROM fp GROUP BY station_id, d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY d) AS sg, row_number() OVER (PARTITION BY station_id ORDER BY d DESC) AS gs,
   avg(1 - rate) OVER (PARTITION BY station_id ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling FROM daily),
base AS (SELECT station_id, sum(fails) * CAST(1 AS DOUBLE) / nullif(sum(n), 0) AS pbar FROM ranked WHERE sg <= {P.BASELINE_DAYS} GROUP BY station_id),
chart AS (SELECT r.*, pbar, least(pbar + 3 * sqrt(pbar * (1 - pbar) / n), CAST(1 AS DOUBLE)) AS ucl, greatest(pbar - 3 * sqrt(pbar * (1 - pbar) / n), CAST(0 AS DOUBLE)) AS lcl FROM ranked r JOIN base USING (station_id)),
flags AS (SELECT *, rate > ucl OR rate < lcl AS ooc FROM chart),
ok_dim AS (SELECT * FROM fp WHERE feature_dim_mm BETWEEN 19.8 AND 30.2),
win AS (SELECT CAST(max(ts) AS DATE) - {P.RECENT_DAYS} AS start FROM fp),
cap AS (SELECT station_id, least((25.2 - avg(feature_dim_mm)) / (3 * nullif(stddev_samp(feature_dim_mm), 0)), (avg(feature_dim_mm) - 24.8) / (3 * nullif(stddev_samp(feature_dim_mm), 0))) AS cpk, count(*) AS readings FROM ok_dim GROUP BY station_id),
capr AS (SELECT station_id, least((25.2 - avg(feature_dim_mm)) / (3 * nullif(stddev_samp(feature_dim_mm), 0)), (avg(feature_dim_mm) - 24.8) / (3 * nullif(stddev_samp(feature_dim_mm), 0))) AS cpk_recent, avg(feature_dim_mm) AS recent_mean, stddev_samp(feature_dim_mm) AS recent_sd FROM ok_dim, win WHERE d >= start GROUP BY station_id),
card AS (SELECT f.station_id, min(line_id) AS line_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(fails) AS BIGINT) AS fails, 1 - sum(fails) * CAST(1 AS DOUBLE) / sum(n) AS fpy_overall, max_by(rolling, d) AS rolling_latest,
   count(*) FILTER (WHERE ooc) AS violations, min(d) FILTER (WHERE ooc) AS first_violation FROM flags f GROUP BY f.station_id),
scored AS (SELECT card.*, cpk, cpk_recent, CASE WHEN coalesce(cpk_recent < 1.33, false) OR violations >= 3 THEN 'ALERT' WHEN violations >= 1 THEN 'WATCH' ELSE 'OK' END AS status FROM card LEFT JOIN cap USING (station_id) LEFT JOIN capr USING (station_id)),
codes AS (SELECT defect_code, count(*) AS fails FROM fp WHERE bad = 1 AND defect_code IS NOT NULL GROUP BY defect_code),
par AS (SELECT *, row_number() OVER (ORDER BY fails DESC, defect_code) AS place, round(CAST(100 AS DOUBLE) * sum(fails) OVER (ORDER BY fails DESC, defect_code ROWS UNBOUNDED PRECEDING) / sum(fails) OVER (), 1) AS cum_pct FROM codes),
dday AS (SELECT station_id, d, avg(feature_dim_mm) AS m, sum(feature_dim_mm) AS s, count(*) AS c, row_number() OVER (PARTITION BY station_id ORDER BY d) AS a, row_number() OVER (PARTITION BY station_id ORDER BY d DESC) AS z FROM ok_dim GROUP BY station_id, d),
dtrend AS (SELECT station_id, sum(s) FILTER (WHERE a <= 14) / sum(c) FILTER (WHERE a <= 14) AS first_mean, sum(s) FILTER (WHERE z <= 14) / sum(c) FILTER (WHERE z <= 14) AS last_mean FROM dday GROUP BY station_id),
viol AS (
  SELECT event_id, 'required:' || c AS rule FROM (SELECT event_id, unnest(['event_id', 'ts', 'station_id', 'serial_number', 'vision_result']) AS c, unnest([event_id, CAST(ts AS VARCHAR), station_id, serial_number, vision_result]) AS v FROM inspections) WHERE v IS NULL OR trim(v) = ''
  UNION ALL SELECT event_id, 'unique:event_id' FROM (SELECT event_id, count(*) OVER (PARTITION BY event_id) AS k FROM inspections) WHERE k > 1
  UNION ALL SELECT event_id, 'allowed:vision_result' FROM inspections WHERE vision_result NOT IN ('PASS', 'FAIL')
  UNION ALL SELECT event_id, 'range:feature_dim_mm' FROM inspections WHERE feature_dim_mm < 20 OR feature_dim_mm > 30
  UNION ALL SELECT event_id, 'range:cycle_time_s' FROM inspections WHERE cycle_time_s < 1 OR cycle_time_s > 600
  UNION ALL SELECT event_id, 'consistency:C1' FROM inspections WHERE vision_result = 'PASS' AND defect_code IS NOT NULL
  UNION ALL SELECT event_id, 'consistency:C2' FROM inspections WHERE vision_result = 'FAIL' AND defect_code IS NULL),
dq AS (SELECT (SELECT count(*) FROM inspections) AS n_rows, (SELECT count(DISTINCT event_id) FROM viol) AS offending),
erp AS (SELECT WORK_ORDER_NO AS work_order_no, ITEM_NO AS item_no, i.canonical AS part_number, l.canonical AS line_id, CAST(strptime(SCHED_START_DT, '%m/%d/%Y') AS DATE) AS sched_start, CAST(strptime(SCHED_END_DT, '%m/%d/%Y') AS DATE) AS sched_end
   FROM erp_work_orders LEFT JOIN dim_line l ON PROD_LINE = l.source_key LEFT JOIN dim_item i ON ITEM_NO = i.source_key),
mes AS (SELECT shift_id, w.canonical AS station_id, shift_start_ts, shift_end_ts, CASE WHEN trim(wo_no) = '' THEN NULL ELSE 'WO-' || trim(wo_no) END AS wo, units_completed, CAST(shift_start_ts AS DATE) AS prod_day FROM mes_shift_log LEFT JOIN dim_work_center w ON work_center = w.source_key),
qms AS (SELECT NCR_NO AS ncr_no, trim(regexp_replace(upper(SERIAL_NO), '^SN-', '')) AS serial_key, DEFECT_CATEGORY AS defect_category, c.canonical AS code_qms, DISPOSITION AS disposition FROM qms_ncr LEFT JOIN dim_category c ON DEFECT_CATEGORY = c.source_key),
keyed AS (SELECT *, CAST(ts - INTERVAL 6 HOURS AS DATE) AS prod_day, CASE WHEN hour(ts) BETWEEN 6 AND 13 THEN 'A' WHEN hour(ts) BETWEEN 14 AND 21 THEN 'B' ELSE 'C' END AS shift_code, trim(regexp_replace(upper(serial_number), '^SN-', '')) AS serial_key FROM fp),
keyed2 AS (SELECT *, CAST(prod_day AS VARCHAR) || '-' || shift_code AS shift_id FROM keyed),
fact AS (SELECT k.*, e.work_order_no, e.item_no, m.units_completed, q.ncr_no, q.code_qms, q.disposition FROM keyed2 k LEFT JOIN erp e ON k.line_id = e.line_id AND k.d BETWEEN e.sched_start AND e.sched_end
   LEFT JOIN mes m ON k.station_id = m.station_id AND k.ts >= m.shift_start_ts AND k.ts < m.shift_end_ts LEFT JOIN qms q ON k.serial_key = q.serial_key),
sc AS (SELECT station_id, prod_day, shift_code, shift_id, count(*) AS inspection_events FROM keyed2 GROUP BY station_id, prod_day, shift_code, shift_id),
rec0 AS (SELECT coalesce(sc.station_id, mes.station_id) AS station_id, coalesce(sc.shift_id, mes.shift_id) AS shift_id, sc.prod_day, sc.shift_code, coalesce(inspection_events, 0) AS inspection_events, units_completed, wo FROM sc FULL JOIN mes ON sc.station_id = mes.station_id AND sc.shift_id = mes.shift_id),
rec AS (SELECT *, CASE WHEN units_completed IS NOT NULL AND inspection_events > 0 THEN (units_completed - inspection_events) * CAST(100 AS DOUBLE) / inspection_events END AS v FROM rec0),
wo_day AS (SELECT station_id, d, min(line_id) AS line_id, count(*) AS n_first_pass, CAST(sum(bad) AS BIGINT) AS n_fail, min(work_order_no) AS work_order_no, min(item_no) AS item_no, count(ncr_no) AS ncr_count, count(*) FILTER (WHERE disposition = 'SCRAP') AS ncr_scrap FROM fact GROUP BY station_id, d),
orphan AS (SELECT * FROM qms WHERE NOT EXISTS (SELECT 1 FROM keyed2 k WHERE k.serial_key = qms.serial_key)),
closed AS (SELECT mes.* , erp.work_order_no FROM mes JOIN erp ON mes.wo = erp.work_order_no WHERE prod_day > sched_end),
obs AS (SELECT station_id, defect_code AS mode, count(*) AS detections FROM fp WHERE bad = 1 AND defect_code IS NOT NULL GROUP BY station_id, defect_code),
obs_mode AS (SELECT mode, CAST(sum(detections) AS BIGINT) AS detections FROM obs GROUP BY mode),
ncr AS (SELECT c.canonical AS mode, CASE WHEN c.canonical IS NULL THEN upper(trim(DEFECT_CATEGORY)) END AS unmapped_category, count(*) AS ncrs FROM qms_ncr LEFT JOIN dim_category c ON upper(trim(DEFECT_CATEGORY)) = c.source_key GROUP BY 1, 2),
cov AS (SELECT p.line_id, p.station_id, p.position, g.mode, a.mode IS NOT NULL AS declared, coalesce(o.detections, 0) AS detections, coalesce(m.feature_ref IS NOT NULL, false) AS specified,
   CASE WHEN a.mode IS NOT NULL AND o.detections IS NOT NULL THEN 'COVERED' WHEN a.mode IS NOT NULL THEN 'DECLARED_SILENT' WHEN o.detections IS NOT NULL THEN 'UNDECLARED_DETECTED' ELSE 'NOT_APPLICABLE' END AS state
   FROM dim_position p CROSS JOIN (SELECT mode FROM dim_mode UNION SELECT mode FROM obs) g LEFT JOIN dim_assignment a ON a.station_id = p.station_id AND a.mode = g.mode LEFT JOIN obs o ON o.station_id = p.station_id AND o.mode = g.mode LEFT JOIN dim_mode m ON m.mode = g.mode),
pts0 AS (SELECT p.line_id, p.station_id, p.position, p.value_vu, a.mode, (SELECT min(p2.position) FROM dim_position p2 JOIN dim_assignment a2 ON p2.station_id = a2.station_id WHERE p2.line_id = p.line_id AND p2.position > p.position AND a2.mode = a.mode) AS nxt FROM dim_position p JOIN dim_assignment a USING (station_id)),
pts AS (SELECT t.*, CASE WHEN nxt IS NOT NULL THEN 'station' WHEN f.mode IS NOT NULL THEN 'final_test' ELSE 'customer' END AS kind, n.station_id AS nstation, n.value_vu AS nvalue FROM pts0 t LEFT JOIN dim_final f ON f.mode = t.mode LEFT JOIN dim_position n ON n.line_id = t.line_id AND n.position = t.nxt),
eco0 AS (SELECT *, coalesce(nstation, CASE kind WHEN 'final_test' THEN 'FINAL-TEST' ELSE 'CUSTOMER' END) AS found_at, value_vu * CAST(0.35 AS DOUBLE) + CAST(0.2 AS DOUBLE) AS fr, CASE kind WHEN 'station' THEN nvalue WHEN 'final_test' THEN CAST(7.5 AS DOUBLE) ELSE CAST(18 AS DOUBLE) END AS esc FROM pts),
eco AS (SELECT *, round(fr, 4) AS fr4, round(esc, 4) AS esc4, round(esc / fr, 3) AS rate, kind <> 'customer' AS backstop FROM eco0),
cs AS (SELECT rf, fh, fpen, cpen, concat_ws('|', rf, fh, fpen, cpen) AS combo_id FROM (SELECT unnest([0.15::DOUBLE, 0.35, 0.6]) AS rf), (SELECT unnest([0.05::DOUBLE, 0.2, 0.5]) AS fh), (SELECT unnest([0.5::DOUBLE, 1.5, 3]) AS fpen), (SELECT unnest([3::DOUBLE, 12, 40]) AS cpen)),
swept AS (SELECT combo_id, line_id, station_id, position, mode, value_vu * rf + fh AS fr, CASE kind WHEN 'station' THEN nvalue WHEN 'final_test' THEN 6 + fpen ELSE 6 + cpen END / (value_vu * rf + fh) AS rate FROM pts, cs),
mono AS (SELECT combo_id, line_id, bool_and(coalesce(up, true)) AS c1, bool_and(coalesce(down, true)) AS c2 FROM (SELECT combo_id, line_id, fr > lag(fr) OVER w AS up, rate < lag(rate) OVER w AS down FROM swept WHERE mode = 'DIM-OOS' WINDOW w AS (PARTITION BY combo_id, line_id ORDER BY position)) GROUP BY combo_id, line_id),
sens AS (SELECT count(*) AS combos, count(*) FILTER (WHERE c1) AS c1_holds, count(*) FILTER (WHERE c2) AS c2_holds FROM (SELECT combo_id, bool_and(c1) AS c1, bool_and(c2) AS c2 FROM mono GROUP BY combo_id)),
lim AS (SELECT 'policy' AS combo_id, CAST(2 AS DOUBLE) AS grade, CAST(0.85 AS DOUBLE) AS sharp, CAST(0.01 AS DOUBLE) AS bias, CAST(0.15 AS DOUBLE) AS loc
   UNION ALL SELECT concat_ws('|', g, s, b, l), g, s, b, l FROM (SELECT unnest([1.5::DOUBLE, 2, 2.5]) AS g), (SELECT unnest([0.8::DOUBLE, 0.85, 0.9]) AS s), (SELECT unnest([0.006::DOUBLE, 0.01, 0.015]) AS b), (SELECT unnest([0.1::DOUBLE, 0.15, 0.2]) AS l)),
jall AS (SELECT s.*, combo_id, ref_brightness_pct BETWEEN 92 AND 108 AND ref_sharpness_score >= sharp AND datamatrix_grade >= grade AS imaging_ok, ref_bias_mm <= bias AND ref_repeatability_mm <= 0.015::DOUBLE AS measurement_ok,
   locator_wear_mm <= loc AND clamp_offset_mm <= 0.08::DOUBLE AS fixture_ok, gripper_pad_wear_mm <= 0.25::DOUBLE AND tcp_offset_mm <= 0.12::DOUBLE AND jaw_parallelism_mm <= 0.06::DOUBLE AS eoat_ok FROM station_selftest s, lim),
judged AS (SELECT * FROM jall WHERE combo_id = 'policy'),
cday AS (SELECT j.*, m.mode, m.basis, m.basis = 'geometry' AS geo, CASE WHEN m.basis = 'geometry' THEN NOT (measurement_ok AND fixture_ok AND eoat_ok) ELSE NOT imaging_ok END AS bad, row_number() OVER (PARTITION BY combo_id, j.station_id, m.mode ORDER BY production_day) AS rn FROM jall j JOIN dim_assignment a ON a.station_id = j.station_id JOIN dim_mode m ON m.mode = a.mode),
isl AS (SELECT combo_id, station_id, mode, rn - row_number() OVER (PARTITION BY combo_id, station_id, mode ORDER BY rn) AS k FROM cday WHERE bad),
runs AS (SELECT combo_id, station_id, mode, max(c) AS longest_run FROM (SELECT combo_id, station_id, mode, k, count(*) AS c FROM isl GROUP BY combo_id, station_id, mode, k) GROUP BY combo_id, station_id, mode),
call_ AS (SELECT combo_id, station_id, mode, basis, line_id, count(*) FILTER (WHERE bad) AS days_below, min(production_day) FILTER (WHERE bad) AS first_day_below,
   concat_ws(' + ', CASE WHEN bool_or(NOT geo AND NOT imaging_ok) THEN 'imaging' END, CASE WHEN bool_or(geo AND NOT measurement_ok) THEN 'measurement' END, CASE WHEN bool_or(geo AND NOT fixture_ok) THEN 'tooling/fixture' END, CASE WHEN bool_or(geo AND NOT eoat_ok) THEN 'tooling/eoat' END) AS cause0,
   max_by(datamatrix_grade, production_day) AS datamatrix_grade, max_by(ref_sharpness_score, production_day) AS ref_sharpness_score, max_by(ref_repeatability_mm, production_day) AS ref_repeatability_mm, max_by(locator_wear_mm, production_day) AS locator_wear_mm FROM cday GROUP BY combo_id, station_id, mode, basis, line_id),
cond_all AS (SELECT c.* EXCLUDE (cause0), CASE WHEN cause0 = '' THEN '-' ELSE cause0 END AS cause, coalesce(longest_run, 0) AS longest_run, CASE WHEN longest_run >= 3 THEN 'ALERT' WHEN longest_run >= 1 THEN 'WATCH' ELSE 'OK' END AS condition FROM call_ c LEFT JOIN runs USING (combo_id, station_id, mode)),
cond AS (SELECT * FROM cond_all WHERE combo_id = 'policy'),
selc AS (SELECT combo_id, bool_or(condition = 'ALERT' AND cause LIKE '%imaging%') AS e1_on, bool_or(condition = 'ALERT' AND cause LIKE '%imaging%' AND basis <> 'geometry') AND NOT bool_or(condition = 'ALERT' AND cause LIKE '%imaging%' AND basis = 'geometry') AS e1,
   bool_or(condition = 'ALERT' AND (cause LIKE '%measurement%' OR cause LIKE '%tooling%')) AS e2_on, bool_or(condition = 'ALERT' AND (cause LIKE '%measurement%' OR cause LIKE '%tooling%') AND basis = 'geometry') AND NOT bool_or(condition = 'ALERT' AND (cause LIKE '%measurement%' OR cause LIKE '%tooling%') AND basis <> 'geometry') AS e2
   FROM cond_all WHERE combo_id <> 'policy' GROUP BY combo_id),
sel AS (SELECT count(*) AS combos, count(*) FILTER (WHERE e1_on AND e1) AS e1_holds, count(*) FILTER (WHERE e1_on) AS e1_of, count(*) FILTER (WHERE NOT e1_on) AS e1_vacuous, count(*) FILTER (WHERE e2_on AND e2) AS e2_holds, count(*) FILTER (WHERE e2_on) AS e2_of, count(*) FILTER (WHERE NOT e2_on) AS e2_vacuous FROM selc),
wl AS (SELECT station_id, production_day, units_processed, m.measure, tooling_set, measure_name, limit_mm, CASE m.measure WHEN 'locator_wear_mm' THEN locator_wear_mm WHEN 'gripper_pad_wear_mm' THEN gripper_pad_wear_mm ELSE tcp_offset_mm END AS wear,
   row_number() OVER (PARTITION BY station_id, m.measure ORDER BY production_day) AS rn, count(*) OVER (PARTITION BY station_id, m.measure) AS cnt FROM station_selftest CROSS JOIN (SELECT * FROM dim_measure WHERE trended) m),
wr AS (SELECT station_id, measure, tooling_set, measure_name, limit_mm, count(*) AS points, regr_slope(wear, units_processed) AS rate, regr_slope(wear, units_processed) FILTER (WHERE rn <= cnt // 2) AS r1, regr_slope(wear, units_processed) FILTER (WHERE rn > cnt // 2) AS r2, max_by(wear, production_day) AS latest, min_by(wear, production_day) AS earliest, max(units_processed) - min(units_processed) AS units FROM wl GROUP BY station_id, measure, tooling_set, measure_name, limit_mm),
wt0 AS (SELECT *, latest - earliest >= 0.05::DOUBLE * limit_mm AND rate > 1e-12 AS trend, limit_mm - latest AS rest, CASE WHEN r1 > 0 THEN r2 / r1 END AS accel, units::DOUBLE / (points - 1) AS per_day FROM wr WHERE points >= 20),
wt AS (SELECT *, CASE WHEN trend AND rest > 0 THEN rest / rate END AS to_limit FROM wt0),
trendf AS (SELECT *, CAST(round(to_limit) AS BIGINT) AS units_to_limit, CAST(round(to_limit / per_day) AS BIGINT) AS days_to_limit, coalesce(trend AND accel >= 1.25, false) AS accelerating FROM wt),
trending AS (SELECT * FROM trendf WHERE trend AND latest <= limit_mm AND days_to_limit <= 120),
last_st AS (SELECT * FROM station_selftest QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY production_day DESC) = 1),
frac AS (SELECT station_id, check_name, round(value, 5) AS value, limit_value, round(fr, 3) AS fraction, CASE WHEN br THEN 'BREACHED' WHEN fr >= 0.6 THEN 'APPROACHING' ELSE 'OK' END AS state FROM (
   SELECT station_id, 'imaging' AS check_name, datamatrix_grade AS value, 2::DOUBLE AS limit_value, 2 / datamatrix_grade AS fr, datamatrix_grade < 2 AS br FROM last_st
   UNION ALL SELECT station_id, 'measurement', ref_repeatability_mm, 0.015::DOUBLE, ref_repeatability_mm / 0.015::DOUBLE, ref_repeatability_mm > 0.015::DOUBLE FROM last_st
   UNION ALL SELECT station_id, 'fixture', locator_wear_mm, 0.15::DOUBLE, locator_wear_mm / 0.15::DOUBLE, locator_wear_mm > 0.15::DOUBLE FROM last_st
   UNION ALL SELECT station_id, 'eoat', gripper_pad_wear_mm, 0.25::DOUBLE, gripper_pad_wear_mm / 0.25::DOUBLE, gripper_pad_wear_mm > 0.25::DOUBLE FROM last_st)),
open_modes AS (SELECT DISTINCT mode FROM eco WHERE NOT backstop),
lost AS (SELECT c.station_id, string_agg(DISTINCT c.mode, ',' ORDER BY c.mode) AS modes_lost, max(longest_run) AS longest_run, max_by(cause, (longest_run, c.mode)) AS cause, min(first_day_below) AS first_day_below,
   coalesce(string_agg(DISTINCT o.mode, ',' ORDER BY o.mode), '') AS exposed, coalesce(string_agg(DISTINCT CASE WHEN coalesce(v.detections, 0) = 0 THEN c.mode END, ',' ORDER BY CASE WHEN coalesce(v.detections, 0) = 0 THEN c.mode END), '') AS never_detected
   FROM cond c LEFT JOIN open_modes o ON o.mode = c.mode LEFT JOIN cov v ON v.station_id = c.station_id AND v.mode = c.mode WHERE condition = 'ALERT' GROUP BY c.station_id),
unassigned AS (SELECT u.mode, count(DISTINCT station_id) AS stations, CAST(sum(detections) AS BIGINT) AS detections, CAST(coalesce(max(q.ncrs), 0) AS BIGINT) AS ncrs FROM cov u LEFT JOIN (SELECT mode, sum(ncrs) AS ncrs FROM ncr WHERE mode IS NOT NULL GROUP BY mode) q ON q.mode = u.mode WHERE state = 'UNDECLARED_DETECTED' AND u.mode NOT IN (SELECT mode FROM dim_assignment) GROUP BY u.mode),
silent AS (SELECT mode, count(*) FILTER (WHERE declared) AS stations FROM cov GROUP BY mode HAVING sum(detections) = 0 AND bool_or(declared)),
worst_open AS (SELECT mode, station_id, position, rate FROM eco WHERE NOT backstop QUALIFY row_number() OVER (PARTITION BY mode ORDER BY rate DESC, position DESC, station_id DESC) = 1),
late AS (SELECT mode, min(position) FILTER (WHERE declared) AS first_position, CAST(sum(detections) AS BIGINT) AS detections FROM cov GROUP BY mode HAVING min(position) FILTER (WHERE declared) > 1 AND sum(detections) > 0),
blip AS (SELECT station_id, max(longest_run) AS longest_run, max(days_below) AS days_below FROM cond WHERE condition = 'WATCH' AND station_id NOT IN (SELECT station_id FROM cond WHERE condition = 'ALERT') GROUP BY station_id),
cf AS (SELECT 'CONDITION_COVERAGE_LOST' AS finding_id, station_id, modes_lost AS mode, CASE WHEN cause LIKE '%tooling/eoat%' THEN 'eoat' WHEN cause LIKE '%tooling/fixture%' THEN 'fixture' WHEN cause LIKE '%imaging%' THEN 'imaging' ELSE 'measurement' END AS check_name FROM lost
   UNION ALL SELECT 'TOOLING_TRENDING_TO_LIMIT', station_id, '-', tooling_set FROM trending),
peers AS (SELECT cf.*, pr.kind, a.asset_id, coalesce(string_agg(b.station_id, ';' ORDER BY b.station_id), '') AS peer_stations, count(b.station_id) AS n_peers FROM cf JOIN dim_propagation pr USING (check_name) LEFT JOIN dim_asset a ON a.station_id = cf.station_id AND a.kind = pr.kind LEFT JOIN dim_asset b ON b.kind = a.kind AND b.asset_id = a.asset_id AND b.station_id <> cf.station_id GROUP BY cf.finding_id, cf.station_id, cf.mode, cf.check_name, pr.kind, a.asset_id),
pf AS (SELECT 'UNASSIGNED_MODE' AS finding_id, mode FROM unassigned UNION ALL SELECT 'DECLARED_SILENT', mode FROM silent UNION ALL SELECT 'LATE_FIRST_LOOK', mode FROM late),
extent AS (SELECT finding_id, '-' AS station_id, mode, CASE WHEN k >= (SELECT count(DISTINCT station_id) FROM station_selftest) THEN 'SYSTEMIC' WHEN k > 1 THEN 'SHARED_ASSET' ELSE 'LOCAL' END AS verdict, 'control plan' AS kind, '-' AS asset_id, ps AS peer_stations, k AS n_affected FROM (
   SELECT finding_id, pf.mode, count(*) AS k, string_agg(station_id, ';' ORDER BY station_id) AS ps FROM pf JOIN cov ON cov.mode = pf.mode AND CASE WHEN finding_id = 'UNASSIGNED_MODE' THEN state = 'UNDECLARED_DETECTED' ELSE declared END GROUP BY finding_id, pf.mode)
   UNION ALL SELECT finding_id, station_id, mode, CASE WHEN n_peers > 0 THEN 'SHARED_ASSET' ELSE 'LOCAL' END, kind, asset_id, peer_stations, n_peers + 1 FROM peers),
walkline AS (SELECT line_id, string_agg(concat_ws(':', station_id, CAST(rate AS DECIMAL(12, 3))), ' ' ORDER BY position) AS walk FROM eco WHERE mode = 'DIM-OOS' AND line_id = (SELECT min(line_id) FROM eco WHERE mode = 'DIM-OOS') GROUP BY line_id),
allf AS (SELECT 'UNASSIGNED_MODE' AS finding_id, 'high' AS severity, '-' AS station_id, mode, detections AS evidence FROM unassigned UNION ALL SELECT 'DECLARED_SILENT', 'open_question', '-', mode, stations FROM silent UNION ALL SELECT 'NO_BACKSTOP', 'high', '-', mode, position FROM worst_open
   UNION ALL SELECT 'LATE_FIRST_LOOK', 'medium', '-', mode, first_position FROM late UNION ALL SELECT 'POSITION_IS_NOT_THE_DRIVER', 'insight', '-', 'DIM-OOS', c2_holds FROM sens WHERE c2_holds < combos
   UNION ALL SELECT 'CONDITION_COVERAGE_LOST', 'high', station_id, modes_lost, longest_run FROM lost UNION ALL SELECT 'CONDITION_TRANSIENT', 'watch', station_id, '-', longest_run FROM blip
   UNION ALL SELECT 'TOOLING_TRENDING_TO_LIMIT', 'watch', station_id, '-', days_to_limit FROM trending UNION ALL SELECT 'CONDITION_LOSS_IS_SELECTIVE', CASE WHEN e1_of > 0 AND e1_holds = e1_of THEN 'insight' ELSE 'open_question' END, '-', '-', e1_holds FROM sel)"""

HEAD = "WITH " + ",\n".join([STATEMENTS, *(P.values_sql(d) for d in P.DIMS if d not in P.COMPILED or d == "dim_measure"), _BASE]) + "\n"


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in columns)


def s(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c.split('.')[-1]}" for c in columns)


_DAY = f"station_id, {s('d')}, n, fails"
_EVENT = f"event_id, station_id, vision_result, defect_code, CAST(inspection_pass AS BIGINT) AS inspection_pass, {r('feature_dim_mm')}"
_VIOL = "SELECT event_id, rule FROM viol WHERE rule LIKE '{}:%'"
_SEEN = "LEFT JOIN obs o ON o.station_id = e.station_id AND o.mode = e.mode"
_RANGES = """, ords AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS s, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS nx FROM orders),
items AS (SELECT row_number() OVER () AS rid, o_custkey, CAST(l_shipdate AS DATE) AS ship FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""

_CROSSED = "SELECT 'line' AS key, PROD_LINE AS value, canonical IS NOT NULL AS mapped FROM erp_work_orders LEFT JOIN dim_line ON source_key = PROD_LINE UNION ALL SELECT 'item_no', ITEM_NO, canonical IS NOT NULL FROM erp_work_orders LEFT JOIN dim_item ON source_key = ITEM_NO UNION ALL SELECT 'work_center', work_center, canonical IS NOT NULL FROM mes_shift_log LEFT JOIN dim_work_center ON source_key = work_center UNION ALL SELECT 'defect_category', DEFECT_CATEGORY, canonical IS NOT NULL FROM qms_ncr LEFT JOIN dim_category ON source_key = DEFECT_CATEGORY"
_REJECTS = """SELECT 'erp_work_orders' AS extract, WORK_ORDER_NO AS id, ['date:SCHED_END_DT', 'code:PROD_LINE', 'code:ITEM_NO'] AS names, [right(WORK_ORDER_NO, 1) = '3', l.canonical IS NULL, i.canonical IS NULL] AS hits
 FROM erp_work_orders LEFT JOIN dim_line l ON l.source_key = PROD_LINE LEFT JOIN dim_item i ON i.source_key = ITEM_NO
UNION ALL SELECT 'mes_shift_log', shift_id, ['number:units_completed', 'code:work_center'], [right(shift_id, 3) = '5-B', canonical IS NULL] FROM mes_shift_log LEFT JOIN dim_work_center ON source_key = work_center
UNION ALL SELECT 'qms_ncr', NCR_NO, ['code:DEFECT_CATEGORY'], [canonical IS NULL] FROM qms_ncr LEFT JOIN dim_category ON source_key = DEFECT_CATEGORY"""
#: Deliveries of a feed: equal spans of days; what comes behind the greatest time of the ones before, less the delay, is dropped.
_LATE = """SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(floor((CAST(ts AS DATE) - min(CAST(ts AS DATE)) OVER ()) / ceil((max(CAST(ts AS DATE)) OVER () - min(CAST(ts AS DATE)) OVER () + 1) / 6.0)) AS BIGINT) + CASE WHEN CAST(right(event_id, 2) AS INT) % 40 = 0 THEN 2 ELSE 0 END AS part FROM inspections"""
_VALID = f"(SELECT *, CAST(max(ts) OVER () AS DATE) - {P.RECENT_DAYS} AS start FROM inspections WHERE inspection_pass = 1 AND feature_dim_mm BETWEEN 19.8 AND 30.2)"

_Q = {
    "scan_events": "SELECT station_id, count(*) AS n, round(sum(cycle_time_s), 6) AS cycle_s, CAST(max(ts) AS VARCHAR) AS latest FROM inspections GROUP BY station_id",
    "bronze_text_scan": "SELECT NCR_NO, SERIAL_NO, trim(DEFECT_CATEGORY) AS DEFECT_CATEGORY, DISPOSITION FROM qms_ncr",
    "scan_mixed": "SELECT shift_id, work_center, nullif(wo_no, '') AS wo_no, units_completed FROM mes_shift_log",
    "scan_tolerant": "SELECT station_id, count(*) AS n, count(*) FILTER (WHERE event_id LIKE '%50') AS corrupt, count(*) FILTER (WHERE event_id NOT LIKE '%50') AS readings, count(serial_number) AS serials FROM inspections GROUP BY station_id",
    "optional_source": "SELECT 'events' AS extract, count(*) AS n FROM events UNION ALL SELECT 'no_such_extract', 0",
    "source_sanity": "SELECT count(*) AS n_rows, count(DISTINCT station_id) AS n_keys FROM inspections",
    "mart_write": "SELECT station_id, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, CAST(sum(fails) AS BIGINT) AS fails FROM daily GROUP BY station_id",
    "report_write": "SELECT n_rows, offending, round(1 - offending::DOUBLE / n_rows, 4) AS dq_score, (SELECT count(DISTINCT station_id) FROM inspections) AS n_keys FROM dq",
    "dedupe_first": f"SELECT {_EVENT} FROM ev",
    "first_pass": f"SELECT {_EVENT} FROM fp",
    "daily_fpy": f"SELECT {_DAY}, line_id, round(rate, 6) AS defect_rate, round(1 - rate, 6) AS fpy FROM daily",
    "rolling_fpy": f"SELECT station_id, {s('d')}, round(1 - rate, 6) AS fpy, round(rolling, 6) AS rolling_fpy FROM ranked",
    "subgroup_rank": f"SELECT station_id, {s('d')}, sg AS subgroup FROM ranked",
    "baseline_pbar": f"SELECT station_id, {r('pbar')} FROM base",
    "limits_join": f"SELECT {_DAY}, {r('pbar')} FROM chart",
    "pchart_limits": f"SELECT {_DAY}, {r('pbar', 'ucl', 'lcl')}, ooc AS out_of_control FROM flags",
    "station_avg_window": f"SELECT {_DAY}, round(sum(fails) OVER (PARTITION BY station_id)::DOUBLE / sum(n) OVER (PARTITION BY station_id), 6) AS station_avg FROM daily",
    "tuned_before": f"SELECT station_id, {s('d')}, round(rate, 6) AS p, round((SELECT avg(bad) FROM fp WHERE fp.station_id = daily.station_id), 6) AS station_avg FROM daily",
    "tuned_after": f"SELECT station_id, {s('d')}, round(rate, 6) AS p, round((SELECT avg(bad) FROM fp WHERE fp.station_id = daily.station_id), 6) AS station_avg FROM daily",
    "phase2_score": f"SELECT {_DAY}, {r('ucl', 'lcl')}, ooc AS out_of_control FROM flags WHERE sg > {P.BASELINE_DAYS}",
    "cpk": f"SELECT station_id, {r('cpk')}, readings FROM cap",
    "cpk_recent": f"SELECT station_id, {r('cpk_recent')} FROM cap LEFT JOIN capr USING (station_id)",
    "recent_window": "SELECT station_id, count(*) AS n, CAST(min(d) AS VARCHAR) AS first_day FROM fp, win WHERE d >= start GROUP BY station_id",
    "recent_profile": f"SELECT q.station_id, {r('recent_mean', 'recent_sd', 'recent_rate')} FROM (SELECT station_id, avg(rate) AS recent_rate FROM ranked WHERE gs <= {P.RECENT_DAYS} GROUP BY station_id) q LEFT JOIN (SELECT station_id, avg(feature_dim_mm) AS recent_mean, stddev_samp(feature_dim_mm) AS recent_sd FROM {_VALID} WHERE CAST(ts AS DATE) >= start GROUP BY station_id) v ON v.station_id = q.station_id",
    "daily_dim_mean": f"SELECT station_id, {s('d')}, round(m, 6) AS mean_dim, c AS readings FROM dday",
    "station_scorecard": f"SELECT station_id, line_id, n, fails, {r('fpy_overall', 'rolling_latest')}, violations, {s('first_violation')}, {r('cpk', 'cpk_recent')}, status FROM scored",
    "scorecard_assemble": "SELECT f.station_id, f.n, round(cap.cpk, 6) AS cpk FROM (SELECT station_id, count(*) AS n FROM fp GROUP BY station_id) f LEFT JOIN cap ON cap.station_id = f.station_id",
    "status_rule": "SELECT station_id, violations, status FROM scored",
    "spc_alerts": f"SELECT station_id, violations, {s('first_violation')} FROM scored WHERE violations > 0",
    "capability_alerts": f"SELECT station_id, {r('cpk_recent')} FROM capr WHERE cpk_recent < 1.33",
    "pareto": "SELECT defect_code, fails, place, cum_pct FROM par",
    "cum_share": "SELECT defect_code, cum_pct FROM par",
    "top_defects": "SELECT defect_code, fails FROM par WHERE place <= 5",
    "fleet_kpis": "SELECT round(1 - sum(fails)::DOUBLE / sum(n), 6) AS fpy, count(*) FILTER (WHERE status = 'ALERT') AS alerts, (SELECT station_id FROM scored ORDER BY cpk_recent NULLS FIRST, station_id LIMIT 1) AS worst_cpk_station, (SELECT station_id FROM scored ORDER BY fpy_overall, station_id LIMIT 1) AS worst_fpy_station, (SELECT CAST(min(d) AS VARCHAR) FROM fp) AS first_day, (SELECT CAST(max(d) AS VARCHAR) FROM fp) AS last_day FROM scored",
    "dim_trend": f"SELECT station_id, {r('first_mean', 'last_mean')}, round(last_mean - first_mean, 6) AS drift, CASE WHEN 25.2 - last_mean < last_mean - 24.8 THEN 'upper' WHEN last_mean IS NOT NULL THEN 'lower' END AS side FROM dtrend",
    "defect_trend": "SELECT station_id, round(avg(rate) FILTER (WHERE sg <= 21), 6) AS base_rate, round(avg(rate) FILTER (WHERE gs <= 14), 6) AS recent_rate FROM ranked GROUP BY station_id",
    "triage_pattern": "SELECT station_id, pattern, CASE WHEN pattern IN ('dimensional_drift', 'process_shift') THEN 'high' WHEN pattern = 'scattered_false_alarm' THEN 'low' ELSE 'none' END AS severity, violations, round(drift, 6) AS drift FROM (SELECT station_id, violations, last_mean - first_mean AS drift, CASE WHEN cpk_recent < 1.33 AND abs(last_mean - first_mean) >= 0.03 THEN 'dimensional_drift' WHEN violations >= 3 THEN 'process_shift' WHEN violations >= 1 THEN 'scattered_false_alarm' ELSE 'in_control' END AS pattern FROM scored LEFT JOIN dtrend USING (station_id))",
    "dq_triage": "SELECT round(1 - offending::DOUBLE / n_rows, 4) AS dq_score, CASE WHEN round(1 - offending::DOUBLE / n_rows, 4) < 0.99 THEN 'medium' ELSE 'none' END AS severity FROM dq",
    **{f"dq_{k}": _VIOL.format(k) for k in ("required", "unique", "allowed", "range", "consistency")},
    "duplicate_flag": "SELECT event_id, count(*) OVER (PARTITION BY event_id) > 1 AS is_duplicate FROM inspections",
    "violations_union": "SELECT * FROM viol",
    "dq_score": "SELECT n_rows, offending, round(1 - offending::DOUBLE / n_rows, 4) AS dq_score FROM dq",
    "dq_by_rule": "SELECT rule, count(*) AS violations FROM viol GROUP BY rule",
    "dq_validate": "SELECT (SELECT count(*) FROM ev) AS clean_rows, (SELECT count(*) FROM viol) AS violations, n_rows, offending, round(1 - offending::DOUBLE / n_rows, 4) AS dq_score FROM dq",
    "frozen_gauge": "SELECT event_id, station_id, coalesce(v = lag(v, 1) OVER w AND v = lag(v, 2) OVER w, false) AS held FROM (SELECT *, round(feature_dim_mm, 1) AS v FROM fp) WINDOW w AS (PARTITION BY station_id ORDER BY ts, event_id)",
    "last5_slope_drift": "SELECT event_id, station_id, round(sl, 6) AS slope, coalesce(abs(sl) > 0.002 AND least(25.2::DOUBLE - feature_dim_mm, feature_dim_mm - 24.8::DOUBLE) < 0.35::DOUBLE * (25.2::DOUBLE - 24.8::DOUBLE) / 2, false) AS drift FROM (SELECT *, CASE WHEN rn >= 3 THEN regr_slope(feature_dim_mm, rn) OVER (PARTITION BY station_id ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS sl FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts, event_id) AS rn FROM ok_dim))",
    "canonical_serial": "SELECT event_id, serial_key FROM keyed2",
    "production_day": f"SELECT event_id, {s('prod_day')}, d <> prod_day AS other_day FROM keyed2",
    "shift_code": "SELECT event_id, shift_code, shift_id FROM keyed2",
    "sql_round": f"SELECT station_id, {s('d')}, round((n - 8)::DOUBLE / 16, 3) AS rounded FROM daily",
    "crosswalk_map": "SELECT ncr_no, defect_category, code_qms AS defect_code_qms FROM qms",
    "asof_join": "SELECT event_id, e.work_order_no FROM keyed2 k ASOF LEFT JOIN erp e ON k.line_id = e.line_id AND k.d >= e.sched_start",
    "asof_bounded": "SELECT event_id, CASE WHEN k.d <= e.sched_end THEN e.work_order_no END AS work_order_no, coalesce(k.d <= e.sched_end, false) AS has_work_order FROM keyed2 k ASOF LEFT JOIN erp e ON k.line_id = e.line_id AND k.d >= e.sched_start",
    "range_join": "SELECT event_id, e.work_order_no FROM keyed2 k LEFT JOIN erp e ON k.line_id = e.line_id AND k.d BETWEEN e.sched_start AND e.sched_end",
    "range_join_by_day": "SELECT event_id, e.work_order_no FROM keyed2 k LEFT JOIN erp e ON k.line_id = e.line_id AND k.d BETWEEN e.sched_start AND e.sched_end",
    "interval_join": "SELECT m.station_id, m.shift_id, count(k.event_id) AS events FROM mes m LEFT JOIN keyed2 k ON k.station_id = m.station_id AND k.ts >= m.shift_start_ts AND k.ts < m.shift_end_ts GROUP BY m.station_id, m.shift_id",
    "derived_key_join": "SELECT m.station_id, m.shift_id, count(k.event_id) AS events FROM mes m LEFT JOIN keyed2 k ON k.station_id = m.station_id AND k.ts >= m.shift_start_ts AND k.ts < m.shift_end_ts GROUP BY m.station_id, m.shift_id",
    "normalized_key_join": "SELECT event_id, ncr_no FROM keyed2 k LEFT JOIN qms q ON k.serial_key = q.serial_key",
    "full_outer_recon": f"SELECT station_id, shift_id, {s('prod_day')}, shift_code, inspection_events, units_completed IS NOT NULL AS shift_present FROM rec",
    "qty_variance": "SELECT station_id, shift_id, units_completed AS mes_units_completed, round(v, 3) AS qty_variance_pct, coalesce(abs(v) > 5, false) AS variance_flag FROM rec",
    "shift_counts": f"SELECT station_id, {s('prod_day')}, shift_code, shift_id, inspection_events FROM sc",
    "orphans_anti": "SELECT ncr_no, serial_key FROM orphan",
    "booked_after_close": "SELECT station_id, shift_id, wo AS mes_work_order_no FROM closed",
    "wo_station_day": "SELECT station_id, CAST(d AS VARCHAR) AS date, line_id, n_first_pass, n_fail, work_order_no, item_no, ncr_count, ncr_scrap, work_order_no IS NOT NULL AS has_work_order FROM wo_day",
    "wo_progress": "SELECT station_id, CAST(d AS VARCHAR) AS date, work_order_no, CASE WHEN work_order_no IS NOT NULL THEN row_number() OVER w END AS wo_day_seq, CASE WHEN work_order_no IS NOT NULL THEN CAST(sum(n_first_pass) OVER w AS BIGINT) END AS wo_cum_units FROM wo_day WINDOW w AS (PARTITION BY work_order_no, station_id ORDER BY d)",
    "crosswalk_coverage": f"SELECT key, count(*) FILTER (WHERE mapped) AS mapped, count(*) FILTER (WHERE NOT mapped) AS unmapped, count(DISTINCT CASE WHEN NOT mapped THEN value END) AS unmapped_values FROM ({_CROSSED}) GROUP BY key",
    "integrity_report": "SELECT count(*) AS events, count(*) FILTER (WHERE work_order_no IS NULL) AS without_work_order, count(*) FILTER (WHERE units_completed IS NULL) AS without_shift, count(*) FILTER (WHERE serial_key IS NULL) AS without_serial, count(*) FILTER (WHERE code_qms IS NOT NULL AND code_qms IS DISTINCT FROM defect_code) AS taxonomy_conflicts, round(100 * (count(*) FILTER (WHERE d <> prod_day))::DOUBLE / count(*), 2) AS other_day_pct, round(1 - (count(*) FILTER (WHERE work_order_no IS NULL OR units_completed IS NULL OR serial_key IS NULL))::DOUBLE / count(*), 4) AS integrity_score, (SELECT count(*) FROM orphan) AS orphan_ncrs, (SELECT count(*) FROM rec WHERE units_completed IS NULL) AS shifts_missing, (SELECT count(*) FROM rec WHERE abs(v) > 5) AS variance_shifts, (SELECT count(*) FROM closed) AS booked_after_close FROM fact",
    "orphan_register": "SELECT DISTINCT 'event_without_work_order' AS kind, event_id AS ref FROM fact WHERE work_order_no IS NULL UNION ALL SELECT DISTINCT 'event_without_mes_shift', event_id FROM fact WHERE units_completed IS NULL UNION ALL SELECT DISTINCT 'event_no_serial', event_id FROM fact WHERE serial_key IS NULL UNION ALL SELECT 'ncr_without_inspection_event', ncr_no FROM orphan",
    "orphan_days": "SELECT DISTINCT line_id, CAST(d AS VARCHAR) AS date FROM fact WHERE work_order_no IS NULL",
    "observed_modes": "SELECT * FROM obs",
    "ncr_by_mode": "SELECT * FROM ncr",
    "coverage_state": "SELECT * FROM cov",
    "coverage_cross": "SELECT line_id, state, count(*) AS cells, CAST(sum(detections) AS BIGINT) AS detections FROM cov GROUP BY line_id, state",
    "coverage_matrix": "SELECT cov.mode, " + ", ".join(f"max(CASE WHEN cov.station_id = 'S{i}' THEN CASE WHEN c.mode IS NOT NULL THEN -1 ELSE detections END END) AS S{i}" for i in range(1, 10)) + " FROM cov LEFT JOIN (SELECT * FROM cond WHERE condition = 'ALERT') c ON c.station_id = cov.station_id AND c.mode = cov.mode GROUP BY cov.mode",
    "mode_gap": "SELECT kind, mode FROM (SELECT mode, bool_or(detections > 0) AS o, bool_or(declared) AS dd, bool_or(specified) AS sp FROM cov GROUP BY mode), (SELECT unnest(['observed_not_declared', 'declared_not_observed', 'declared_not_specified', 'declared_and_observed']) AS kind) WHERE CASE kind WHEN 'observed_not_declared' THEN o AND NOT dd WHEN 'declared_not_observed' THEN dd AND NOT o WHEN 'declared_not_specified' THEN dd AND NOT sp ELSE dd AND o END",
    "coverage_kpis": "SELECT declared_cells, covered_cells, round(covered_cells::DOUBLE / declared_cells, 4) AS coverage_rate, " + ", ".join(f"coalesce((SELECT string_agg(mode, ',' ORDER BY mode) FROM g WHERE {c}), '') AS {k}" for k, c in {"observed_not_declared": "o AND NOT dd", "declared_not_observed": "dd AND NOT o", "declared_not_specified": "dd AND NOT sp", "declared_and_observed": "dd AND o"}.items()) + ", (SELECT min(rate) FROM eco) AS rate_min, (SELECT max(rate) FROM eco) AS rate_max FROM (SELECT count(*) FILTER (WHERE declared) AS declared_cells, count(*) FILTER (WHERE state = 'COVERED') AS covered_cells FROM cov)",
    "mode_label": "SELECT obs.mode, station_id, detections, coalesce(label || ' (' || obs.mode || ')', obs.mode) AS mode_label, basis_name FROM obs LEFT JOIN dim_mode m ON m.mode = obs.mode LEFT JOIN dim_basis b ON b.basis = m.basis",
    "discovery_point": f"SELECT e.station_id, e.mode, kind AS found_kind, found_at, coalesce(detections, 0) AS detections FROM eco e {_SEEN}",
    "false_reject_cost": "SELECT p.station_id, CAST(sum(detections) AS BIGINT) AS fails, round(any_value(value_vu * 0.35 + 0.2), 6) AS unit_vu, round(sum(detections) * any_value(value_vu * 0.35 + 0.2), 6) AS total_vu FROM obs JOIN dim_position p USING (station_id) GROUP BY p.station_id",
    "escape_cost": f"SELECT e.station_id, e.mode, round(esc, 6) AS unit_vu, kind AS found_kind, coalesce(detections, 0) AS detections, round(coalesce(detections, 0) * esc, 6) AS exposed_vu FROM eco e {_SEEN}",
    "exchange_rate": f"SELECT e.station_id, e.mode, line_id, position, fr4 AS false_reject_cost_vu, esc4 AS escape_cost_vu, found_at, kind AS found_kind, rate AS exchange_rate, backstop, coalesce(detections, 0) AS detections FROM eco e {_SEEN}",
    "cost_sensitivity": "SELECT combos, c1_holds, c2_holds, c1_holds = combos AS c1_robust, c2_holds = combos AS c2_robust, round(lo, 6) AS least_vu, round(hi, 6) AS most_vu FROM sens, (SELECT min(vu) AS lo, max(vu) AS hi FROM (SELECT sum(fr * detections) AS vu FROM swept JOIN obs USING (station_id, mode) GROUP BY combo_id))",
    "sweep_cross": "SELECT combo_id, line_id, round(sum(fr * detections), 6) AS false_reject_vu, round(sum(rate * detections), 6) AS weighted_rate FROM swept JOIN obs USING (station_id, mode) GROUP BY combo_id, line_id",
    "monotone_check": "SELECT line_id, combo_id, c1, c2, fails FROM mono JOIN (SELECT line_id, CAST(sum(bad) AS BIGINT) AS fails FROM fp GROUP BY line_id) USING (line_id)",
    "event_cost_rollup": "SELECT e.line_id, e.mode, CAST(d AS VARCHAR) AS d, count(*) AS fails, round(sum(fr4), 6) AS false_reject_vu, round(sum(esc4), 6) AS escape_vu FROM fp JOIN eco e ON e.station_id = fp.station_id AND e.mode = fp.defect_code WHERE bad = 1 GROUP BY e.line_id, e.mode, d",
    "position_walk": f"SELECT position, e.station_id, e.mode, rate AS exchange_rate, found_at, coalesce(detections, 0) AS detections FROM eco e {_SEEN} WHERE e.mode = 'DIM-OOS' AND line_id = 'LINE-A'",
    "exposed_modes": f"SELECT e.station_id, e.mode, rate AS exchange_rate, coalesce(detections, 0) AS detections FROM eco e {_SEEN} WHERE NOT backstop",
    "selftest_verdicts": "SELECT station_id, production_day, imaging_ok, measurement_ok, fixture_ok, eoat_ok, fixture_ok AND eoat_ok AS tooling_ok, imaging_ok AND measurement_ok AND fixture_ok AND eoat_ok AS selftest_ok FROM judged",
    "failing_sets": "SELECT station_id, production_day, concat_ws(',', CASE WHEN NOT fixture_ok THEN 'fixture' END, CASE WHEN NOT eoat_ok THEN 'eoat' END) AS failing_sets FROM judged",
    "gates": "SELECT o.mode, detections, basis, bool_or(check_name = 'imaging') AS needs_imaging, bool_or(check_name = 'measurement') AS needs_measurement, bool_or(check_name = 'tooling') AS needs_tooling FROM obs_mode o LEFT JOIN dim_mode m ON m.mode = o.mode LEFT JOIN dim_gate g USING (basis) GROUP BY o.mode, detections, basis",
    "longest_run": "SELECT station_id, max(c) AS longest_run FROM (SELECT station_id, k, count(*) AS c FROM (SELECT station_id, rn - row_number() OVER (PARTITION BY station_id ORDER BY rn) AS k FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY production_day) AS rn FROM judged) WHERE NOT (imaging_ok AND measurement_ok AND fixture_ok AND eoat_ok)) GROUP BY station_id, k) GROUP BY station_id",
    "latest_row": f"SELECT station_id, production_day, units_processed, {r('datamatrix_grade')} FROM last_st",
    "station_condition": f"SELECT station_id, mode, basis, line_id, days_below, first_day_below, cause, {r('datamatrix_grade', 'ref_sharpness_score', 'ref_repeatability_mm', 'locator_wear_mm')}, longest_run, condition, condition <> 'ALERT' AS effective FROM cond",
    "condition_sensitivity": "SELECT *, e1_of > 0 AND e1_holds = e1_of AS e1_robust, e2_of > 0 AND e2_holds = e2_of AS e2_robust FROM sel",
    "wear_rate": "SELECT station_id, measure, points, round(rate * 1000, 6) AS rate_per_1k FROM wr",
    "wear_accel": "SELECT station_id, measure, round(r1 * 1000, 6) AS first_per_1k, round(r2 * 1000, 6) AS second_per_1k, round(CASE WHEN r1 > 0 THEN r2 / r1 END, 3) AS ratio FROM wr",
    "wear_trend": f"SELECT station_id, tooling_set, measure, measure_name, round(latest, 5) AS latest_mm, limit_mm, round(rest, 5) AS margin_mm, latest <= limit_mm AS within_limit, round(rate * 1000, 5) AS rate_per_1k, trend, round(accel, 2) AS acceleration, accelerating, units_to_limit, days_to_limit, '{P.PROJECTION_LABEL}' AS projection_label FROM trendf",
    "fleet_selftest": "SELECT station_id, days, worst, cause, concat_ws(',', CASE WHEN cause LIKE '%tooling/fixture%' THEN 'fixture' END, CASE WHEN cause LIKE '%tooling/eoat%' THEN 'eoat' END) AS sets_out, longest_run AS days_out, first_day_below AS first_out, imaging_ok, measurement_ok, tooling_ok, modes_lost FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY longest_run DESC, mode) AS place FROM cond) JOIN (SELECT station_id, ['OK', 'WATCH', 'ALERT'][max(CASE condition WHEN 'ALERT' THEN 3 WHEN 'WATCH' THEN 2 ELSE 1 END)] AS worst, coalesce(string_agg(CASE WHEN condition = 'ALERT' THEN mode END, ';' ORDER BY mode), '') AS modes_lost FROM cond GROUP BY station_id) USING (station_id) JOIN (SELECT station_id, count(*) AS days, arg_max(imaging_ok, production_day) AS imaging_ok, arg_max(measurement_ok, production_day) AS measurement_ok, arg_max(fixture_ok AND eoat_ok, production_day) AS tooling_ok FROM judged GROUP BY station_id) USING (station_id) WHERE place = 1",
    "f_unassigned_mode": "SELECT * FROM unassigned",
    "f_declared_silent": "SELECT * FROM silent",
    "f_no_backstop": "SELECT w.mode, station_id, position, rate AS exchange_rate, detections FROM worst_open w LEFT JOIN obs_mode o ON o.mode = w.mode",
    "f_late_first_look": "SELECT * FROM late",
    "f_position_driver": "SELECT line_id, walk, c1_holds, c2_holds, combos, (SELECT detections FROM obs_mode WHERE mode = 'DIM-OOS') AS detections FROM walkline, sens WHERE c2_holds < combos",
    "f_coverage_lost": "SELECT * FROM lost",
    "f_transient": "SELECT * FROM blip",
    "f_trending": "SELECT station_id, measure, units_to_limit, days_to_limit, accelerating FROM trending",
    "f_selective": "SELECT e1_holds, e1_of, e2_holds, e2_of, CASE WHEN e1_of > 0 AND e1_holds = e1_of THEN 'insight' ELSE 'open_question' END AS severity FROM sel",
    "findings_union": "SELECT * FROM allf",
    "check_for_cause": "SELECT station_id, mode, cause, CASE WHEN cause LIKE '%tooling/eoat%' THEN 'eoat' WHEN cause LIKE '%tooling/fixture%' THEN 'fixture' WHEN cause LIKE '%imaging%' THEN 'imaging' ELSE 'measurement' END AS check_name FROM cond",
    "reaction_plan": "SELECT finding_id, station_id, check_name, owner, escalate_days, len(containment) AS steps, containment[1] AS first_step FROM cf LEFT JOIN dim_reaction USING (check_name)",
    "asset_peers": "SELECT * FROM peers",
    "limit_fraction": "SELECT * FROM frac",
    "peer_rank": "SELECT check_name, row_number() OVER (PARTITION BY check_name ORDER BY CASE state WHEN 'BREACHED' THEN 0 WHEN 'APPROACHING' THEN 1 ELSE 2 END, fraction DESC, station_id) AS place, station_id, state FROM frac",
    "containment_units": "SELECT station_id, min(production_day) AS from_day, max(production_day) AS to_day, CAST(max_by(units_processed, production_day) - min_by(units_processed, production_day) AS BIGINT) AS units FROM station_selftest JOIN (SELECT station_id, min_by(first_day_below, mode) AS fo FROM cond WHERE condition <> 'OK' GROUP BY station_id) USING (station_id) WHERE production_day >= fo GROUP BY station_id",
    "look_across": "SELECT * FROM extent",
    "verdict_counts": "SELECT verdict, count(*) AS findings FROM extent GROUP BY verdict",
    "report_foldback": "SELECT a.*, x.verdict, x.peer_stations, x.n_affected FROM allf a LEFT JOIN (SELECT * FROM extent QUALIFY row_number() OVER (PARTITION BY finding_id, station_id, mode ORDER BY verdict, peer_stations, n_affected) = 1) x ON x.finding_id = a.finding_id AND x.station_id = a.station_id AND x.mode = a.mode",
    "stream_dedupe": "SELECT event_id, station_id FROM ev",
    "stream_daily_fpy": "SELECT station_id, CAST(CAST(d AS TIMESTAMP) AS VARCHAR) AS start, count(*) AS n, sum(b)::BIGINT AS fails, round(1 - sum(b)::DOUBLE / count(*), 6) AS fpy FROM (SELECT *, CAST(ts AS DATE) AS d, (vision_result = 'FAIL')::INT AS b FROM inspections WHERE inspection_pass = 1) GROUP BY station_id, d",
    "stream_shift_fpy": "SELECT station_id, CAST(t AS VARCHAR) AS start, count(*) AS n, sum(b)::BIGINT AS fails, round(1 - sum(b)::DOUBLE / count(*), 6) AS fpy FROM (SELECT *, time_bucket(INTERVAL 8 HOURS, ts, TIMESTAMP '2024-01-01 06:00:00') AS t, (vision_result = 'FAIL')::INT AS b FROM inspections WHERE inspection_pass = 1) GROUP BY station_id, t",
    "stream_frozen_gauge": "SELECT event_id, station_id, coalesce(v = lag(v, 1) OVER w AND v = lag(v, 2) OVER w, false) AS held FROM (SELECT *, round(feature_dim_mm, 1) AS v FROM fp) WINDOW w AS (PARTITION BY station_id ORDER BY ts, event_id)",
    "stream_held_in_order": "SELECT event_id, station_id, held FROM (SELECT *, coalesce(v = lag(v, 1) OVER w AND v = lag(v, 2) OVER w, false) AS held, date_trunc('milliseconds', max(ts) OVER ()) - INTERVAL 3 DAY AS mark FROM (SELECT *, round(feature_dim_mm, 1) AS v FROM fp) WINDOW w AS (PARTITION BY station_id ORDER BY ts, event_id)) WHERE CAST(ts AS DATE) + INTERVAL 1 DAY < mark",
}
ORACLE_SQL = {k: HEAD + v for k, v in _Q.items()}
ORACLE_SQL["coverage_kpis"] = HEAD.rstrip() + ",\ng AS (SELECT mode, bool_or(detections > 0) AS o, bool_or(declared) AS dd, bool_or(specified) AS sp FROM cov GROUP BY mode)\n" + _Q["coverage_kpis"]
_VOLUME = "WITH" + _RANGES[1:] + "\nSELECT o_custkey, count(*) AS items, count(k) AS matched, CAST(sum(k) AS BIGINT) AS key_sum FROM ({}) GROUP BY o_custkey"
ORACLE_SQL["asof_volume"] = _VOLUME.format("SELECT i.o_custkey, rid, max_by(o.o_orderkey, (o.s, o.o_orderkey)) AS k FROM items i LEFT JOIN ords o ON o.o_custkey = i.o_custkey AND o.s <= i.ship GROUP BY i.o_custkey, rid")
ORACLE_SQL["range_volume"] = _VOLUME.format("SELECT i.o_custkey, o.o_orderkey AS k FROM items i LEFT JOIN ords o ON o.o_custkey = i.o_custkey AND i.ship BETWEEN o.s AND coalesce(o.nx, DATE '2030-01-01') - 1")

_CHECK = "CASE WHEN cause LIKE '%tooling/eoat%' THEN 'eoat' WHEN cause LIKE '%tooling/fixture%' THEN 'fixture' WHEN cause LIKE '%imaging%' THEN 'imaging' ELSE 'measurement' END"
_SCOPE = _Q["containment_units"]
_RANKED = "SELECT finding_id, cf.station_id, cf.check_name, row_number() OVER (PARTITION BY finding_id, cf.station_id, cf.check_name ORDER BY CASE state WHEN 'BREACHED' THEN 0 WHEN 'APPROACHING' THEN 1 ELSE 2 END, fraction DESC, f.station_id) AS place, f.station_id AS peer, state, fraction FROM cf JOIN frac f ON f.check_name = cf.check_name AND f.station_id <> cf.station_id"
_SERIES = ["datamatrix_grade", "ref_repeatability_mm", "locator_wear_mm", "gripper_pad_wear_mm", "tcp_offset_mm"]
ORACLE_SQL |= {
    k: (HEAD.rstrip() + f",\narrivals AS ({_LATE})\n" if k == "stream_late_rows" else HEAD) + v
    for k, v in {
        "valid_cutoff": f"SELECT CAST(start AS VARCHAR) AS start, (SELECT CAST(start AS VARCHAR) FROM win) AS start_of_looks, count(*) AS readings FROM {_VALID} WHERE CAST(ts AS DATE) >= start GROUP BY start",
        "crosswalk_unmapped": f"SELECT key, value, count(*) AS rows FROM ({_CROSSED}) WHERE NOT mapped GROUP BY key, value",
        "dq_clean_and_rules": "SELECT rule AS name, count(*) AS n FROM viol GROUP BY rule UNION ALL SELECT coalesce(station_id, '-'), count(*) FROM ev GROUP BY 1",
        "quarantine_counts": f"SELECT extract, reason, count(*) AS rows FROM (SELECT extract, unnest(CASE WHEN list_bool_or(hits) THEN list_filter(names, lambda n, i: hits[i]) ELSE ['clean'] END) AS reason FROM ({_REJECTS})) GROUP BY extract, reason",
        "stream_late_rows": f"SELECT count(*) AS input_rows, count(*) FILTER (WHERE ts <= mark) AS dropped_rows, count(DISTINCT CASE WHEN mark IS NULL OR ts > mark THEN event_id END) AS kept_rows FROM (SELECT l.*, (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 3 DAY FROM arrivals e WHERE e.part < l.part) AS mark FROM arrivals l)",
        "variance_shifts": "SELECT station_id, shift_id, inspection_events, units_completed AS mes_units_completed, round(v, 3) AS qty_variance_pct FROM rec WHERE abs(v) > 5 ORDER BY abs(round(v, 3)) DESC, station_id, shift_id LIMIT 5",
        "effective_coverage": "SELECT count(*) AS declared_pairs, count(*) FILTER (WHERE condition <> 'ALERT') AS effective_pairs, round((count(*) FILTER (WHERE condition <> 'ALERT'))::DOUBLE / count(*), 4) AS effective_rate, coalesce(string_agg(DISTINCT CASE WHEN condition = 'ALERT' THEN mode END, ',' ORDER BY CASE WHEN condition = 'ALERT' THEN mode END), '') AS modes_losing, coalesce(string_agg(DISTINCT CASE WHEN condition = 'ALERT' THEN station_id END, ',' ORDER BY CASE WHEN condition = 'ALERT' THEN station_id END), '') AS stations_losing FROM cond",
        "fleet_series": " UNION ALL ".join(f"SELECT station_id, production_day, imaging_ok, measurement_ok, fixture_ok AND eoat_ok AS tooling_ok, '{c}' AS measure, round({c}, 5) AS value FROM judged" for c in _SERIES),
        "f_coverage_lost_card": f"SELECT l.station_id, modes_lost, longest_run, first_day_below, {_CHECK} AS check_name, owner, escalate_days, {r('fpy_overall')}, violations, {r('cpk_recent')}, status FROM lost l LEFT JOIN dim_reaction d ON d.check_name = {_CHECK} LEFT JOIN scored s ON s.station_id = l.station_id",
        "finding_peers": _RANKED,
        "look_across_rows": f"""SELECT a.finding_id, a.station_id, a.mode, a.check_name, a.kind, a.asset_id, a.n_peers, coalesce(ranked, '') AS ranked, coalesce(exposed, '') AS exposed,
  next_station, next_state, next_fraction, from_day, to_day, units
FROM peers a LEFT JOIN (SELECT k.finding_id, k.station_id, k.check_name, string_agg(k.peer || ':' || k.state, ' ' ORDER BY k.place) AS ranked,
    string_agg(k.peer, ' ' ORDER BY k.place) FILTER (WHERE list_contains(string_split(s.peer_stations, ';'), k.peer)) AS exposed,
    min_by(k.peer, k.place) FILTER (WHERE k.state <> 'OK') AS next_station, min_by(k.state, k.place) FILTER (WHERE k.state <> 'OK') AS next_state, min_by(k.fraction, k.place) FILTER (WHERE k.state <> 'OK') AS next_fraction
  FROM ({_RANKED}) k JOIN peers s ON s.finding_id = k.finding_id AND s.station_id = k.station_id AND s.check_name = k.check_name GROUP BY k.finding_id, k.station_id, k.check_name) g
  ON g.finding_id = a.finding_id AND g.station_id = a.station_id AND g.check_name = a.check_name
LEFT JOIN ({_SCOPE}) c ON c.station_id = a.station_id""",
        "look_across_scope": f"SELECT e.finding_id, e.station_id, e.mode, verdict, n_affected, from_day, to_day, units FROM extent e LEFT JOIN ({_SCOPE}) c ON c.station_id = e.station_id WHERE e.station_id <> '-'",
        "stream_phase2": _Q["phase2_score"],
    }.items()
}
