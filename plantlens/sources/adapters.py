"""Station data derived from the ``events`` table.

Every statement runs in Spark and in DuckDB: the queries read the views that
Spark makes of it, their SQL twins put it before them in a WITH clause. Only
ids longer than their padding differ: the views keep them whole, the twins cut
them, so the two agree below id 1,000,000. All extracts are derived from the events, so they grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

D = "CAST({} AS DOUBLE)"
_EVENTS = """
b AS (
 SELECT event_id AS id, ts, user_id % 9 AS s, day(ts) - 1 AS dd, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
        CAST(event_id * 7919 % 997 AS DOUBLE) / CAST(997 AS DOUBLE) + CAST(event_id * 104729 % 991 AS DOUBLE) / CAST(991 AS DOUBLE)
      + CAST(event_id * 1299709 % 983 AS DOUBLE) / CAST(983 AS DOUBLE) + CAST(event_id * 15485863 % 977 AS DOUBLE) / CAST(977 AS DOUBLE) AS u
 FROM events),
m AS (
 SELECT *, CASE WHEN id % 197 = 0 THEN CAST(-999 AS DOUBLE)
   ELSE round(CAST(25 AS DOUBLE) + (u - 2) * CAST(0.078 AS DOUBLE) + CASE WHEN s = 2 THEN dd * CAST(0.005 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 4) END AS dim,
   CASE WHEN (event_type = 'error' AND value < 20) OR (s = 4 AND dd >= 20 AND value > 60) THEN 1 ELSE 0 END AS f
 FROM b),
r AS (
 SELECT *, CASE WHEN id % 251 = 0 THEN 'PASS' WHEN f = 1 OR (dim > 20 AND (dim < 24.8 OR dim > 25.2)) THEN 'FAIL' ELSE 'PASS' END AS vr FROM m),
o AS (
 SELECT concat('EVT-', lpad(CAST(id AS STRING), 7, '0')) AS event_id, ts,
   CASE WHEN s < 3 THEN 'LINE-A' WHEN s < 6 THEN 'LINE-B' ELSE 'LINE-C' END AS line_id,
   concat('S', CAST(s + 1 AS STRING)) AS station_id, 'PN-1000' AS part_number,
   CASE WHEN id % 97 = 0 THEN NULL ELSE concat('SN-S', CAST(s + 1 AS STRING), '-', lpad(CAST(dd AS STRING), 2, '0'), '-', lpad(CAST(id AS STRING), 6, '0')) END AS serial_number,
   dim AS feature_dim_mm, vr AS vision_result,
   CASE WHEN id % 251 = 0 THEN 'SRF-SCR' WHEN vr = 'PASS' THEN NULL WHEN dim > 20 AND (dim < 24.8 OR dim > 25.2) THEN 'DIM-OOS'
        WHEN k % 20 < 9 THEN 'SLD-BRDG' WHEN k % 20 < 15 THEN 'CMP-MISS' WHEN k % 20 < 19 THEN 'SRF-SCR' ELSE 'LBL-ERR' END AS defect_code,
   CAST(36 + id % 13 AS DOUBLE) AS cycle_time_s, CASE WHEN id % 50 = 7 THEN 2 ELSE 1 END AS inspection_pass, id
 FROM r),
inspections AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE id % 331 = 0)"""

#: one row per event id and first look, for the extracts below
_ONCE = """
once AS (SELECT DISTINCT event_id, ts, line_id, station_id, serial_number, vision_result, defect_code, inspection_pass, id,
   ts - INTERVAL 6 HOURS AS shifted FROM inspections),
looks AS (SELECT *, CAST(shifted AS DATE) AS prod_day, CASE WHEN hour(ts) < 6 THEN 'C' WHEN hour(ts) < 14 THEN 'A' WHEN hour(ts) < 22 THEN 'B' ELSE 'C' END AS code,
   CAST(substring(station_id, 2) AS INT) AS sn FROM once WHERE inspection_pass = 1)"""

#: five blocks of seven days for each line; one ends early, one is of an item
#: that the crosswalk does not know
_ERP = """
blocks AS (SELECT DISTINCT line_id, CAST(floor((day(ts) - 1) / 7) AS INT) AS blk FROM looks),
erp_work_orders AS (SELECT concat('WO-', CAST(100001 + blk + 10 * CASE line_id WHEN 'LINE-A' THEN 0 WHEN 'LINE-B' THEN 1 ELSE 2 END AS STRING)) AS WORK_ORDER_NO,
   CASE WHEN line_id = 'LINE-B' AND blk = 2 THEN '1000-B' ELSE '1000-C' END AS ITEM_NO,
   replace(line_id, 'LINE-', 'LN_') AS PROD_LINE,
   concat('01/', lpad(CAST(1 + 7 * blk AS STRING), 2, '0'), '/2024') AS SCHED_START_DT,
   concat('01/', lpad(CAST(CASE WHEN line_id = 'LINE-C' AND blk = 3 THEN 5 + 7 * blk WHEN blk = 4 THEN 31 ELSE 7 + 7 * blk END AS STRING), 2, '0'), '/2024') AS SCHED_END_DT
 FROM blocks)"""

_MES = """
shifts AS (SELECT station_id, line_id, sn, prod_day, code, count(*) AS n FROM looks GROUP BY station_id, line_id, sn, prod_day, code),
mes_shift_log AS (SELECT concat(CAST(prod_day AS STRING), '-', code) AS shift_id, concat('WC-0', CAST(sn AS STRING)) AS work_center, code AS shift_code,
   CAST(prod_day AS TIMESTAMP) + CASE code WHEN 'A' THEN INTERVAL 6 HOURS WHEN 'B' THEN INTERVAL 14 HOURS ELSE INTERVAL 22 HOURS END AS shift_start_ts,
   CAST(prod_day AS TIMESTAMP) + CASE code WHEN 'A' THEN INTERVAL 14 HOURS WHEN 'B' THEN INTERVAL 22 HOURS ELSE INTERVAL 30 HOURS END AS shift_end_ts,
   CASE WHEN (day(prod_day) + sn) % 41 = 0 THEN '' ELSE CAST(100001 + CAST(floor((day(prod_day) - 1) / 7) AS INT) + 10 * CASE line_id WHEN 'LINE-A' THEN 0 WHEN 'LINE-B' THEN 1 ELSE 2 END AS STRING) END AS wo_no,
   n + CASE WHEN (day(prod_day) * 27 + sn * 3 + CASE code WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END) % 80 = 0 THEN 20 ELSE 0 END AS units_completed
 FROM shifts WHERE NOT (sn = 6 AND code = 'B' AND day(prod_day) BETWEEN 11 AND 13))"""

_QMS = """
qms_ncr AS (SELECT concat('NCR-', CAST(id AS STRING)) AS NCR_NO,
   concat(lower(replace(serial_number, 'SN-', '')), CASE WHEN id % 160 = 0 THEN '-9999' ELSE '' END) AS SERIAL_NO,
   CASE WHEN id % 200 = 0 THEN 'OTHER' WHEN id % 120 = 0 THEN 'LABELING' WHEN defect_code = 'SLD-BRDG' THEN 'SOLDER' WHEN defect_code = 'CMP-MISS' THEN ' Missing component'
        WHEN defect_code = 'SRF-SCR' THEN 'SURFACE FINISH' WHEN defect_code = 'DIM-OOS' THEN 'DIMENSIONAL' ELSE 'LABELING' END AS DEFECT_CATEGORY,
   CASE WHEN id % 3 = 0 THEN 'SCRAP' ELSE 'REWORK' END AS DISPOSITION
 FROM once WHERE vision_result = 'FAIL' AND serial_number IS NOT NULL AND id % 8 = 0)"""

#: one self-test a station and day; units are those that the station inspected
_SELFTEST = """
station_days AS (SELECT station_id, line_id, sn, CAST(ts AS DATE) AS day_, day(ts) - 1 AS dd, count(*) AS n FROM looks GROUP BY station_id, line_id, sn, CAST(ts AS DATE), day(ts) - 1),
worn AS (SELECT *, CAST(dd AS DOUBLE) / CAST(29 AS DOUBLE) AS f, CAST((dd * 7 + sn * 13) % 11 AS DOUBLE) / CAST(1000 AS DOUBLE) AS e FROM station_days),
station_selftest AS (SELECT CAST(day_ AS STRING) AS production_day, line_id, station_id,
   CAST(sum(n) OVER (PARTITION BY station_id ORDER BY day_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS units_processed,
   CAST(100 AS DOUBLE) - e * 100 AS ref_brightness_pct, CAST(0.95 AS DOUBLE) - e AS ref_sharpness_score,
   CASE WHEN sn = 9 THEN CAST(3.8 AS DOUBLE) - CAST(2.4 AS DOUBLE) * f WHEN sn = 6 AND dd IN (12, 13) THEN CAST(1.7 AS DOUBLE) ELSE CAST(3.6 AS DOUBLE) - e * 10 END AS datamatrix_grade,
   CAST(0.004 AS DOUBLE) + e / 10 AS ref_bias_mm,
   CASE WHEN sn = 2 THEN CAST(0.006 AS DOUBLE) + CAST(0.018 AS DOUBLE) * f WHEN sn = 8 THEN CAST(0.006 AS DOUBLE) + CAST(0.015 AS DOUBLE) * f ELSE CAST(0.006 AS DOUBLE) + e / 10 END AS ref_repeatability_mm,
   CASE WHEN sn = 2 THEN CAST(0.03 AS DOUBLE) + CAST(0.098 AS DOUBLE) * f * f ELSE CAST(0.03 AS DOUBLE) + e / 2 END AS locator_wear_mm,
   CAST(0.02 AS DOUBLE) + e / 2 AS clamp_offset_mm,
   CASE WHEN sn = 8 THEN CAST(0.04 AS DOUBLE) + CAST(0.255 AS DOUBLE) * f ELSE CAST(0.04 AS DOUBLE) + e END AS gripper_pad_wear_mm,
   CASE WHEN sn = 5 THEN CAST(0.02 AS DOUBLE) + CAST(0.084 AS DOUBLE) * f ELSE CAST(0.02 AS DOUBLE) + e / 2 END AS tcp_offset_mm,
   CAST(0.015 AS DOUBLE) + e / 2 AS jaw_parallelism_mm
 FROM worn)"""

#: all of them as the head of a WITH clause
STATEMENTS = ",".join((_EVENTS, _ONCE, _ERP, _MES, _QMS, _SELFTEST))
EXTRACTS = {
    "inspections": "event_id, ts, line_id, station_id, part_number, serial_number, feature_dim_mm, vision_result, defect_code, cycle_time_s, inspection_pass",
    "erp_work_orders": "WORK_ORDER_NO, ITEM_NO, PROD_LINE, SCHED_START_DT, SCHED_END_DT",
    "mes_shift_log": "shift_id, work_center, shift_code, shift_start_ts, shift_end_ts, wo_no, units_completed",
    "qms_ncr": "NCR_NO, SERIAL_NO, DEFECT_CATEGORY, DISPOSITION",
    "station_selftest": "*",
}
#: lpad cuts what is longer; the views pad only what is shorter
_PADS = {f"lpad(CAST(id AS STRING), {n}, '0')": f"lpad(CAST(id AS STRING), greatest({n}, length(CAST(id AS STRING))), '0')" for n in (6, 7)}


def extract(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    statements = STATEMENTS.replace("FROM events)", "FROM {events})")
    for cut, whole in _PADS.items():
        statements = statements.replace(cut, whole)
    return spark.sql(f"WITH {statements} SELECT {EXTRACTS[name]} FROM {name}", events=events)
