"""SQL twins of the streaming jobs: what a batch over the same rows gives, up to the final watermark."""

from __future__ import annotations

from ledgerloom.oracle.layers import dbl
from ledgerloom.streaming.jobs import EVENT_TYPES

QUERIES: dict[str, str] = {}

_MARK = "(SELECT max({c}) - INTERVAL 10 MINUTE FROM {t})"
QUERIES["st_cdc_latest"] = """
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
  l_partkey DESC, l_suppkey DESC) = 1"""
QUERIES["st_fraud_tumbling"] = f"""
SELECT date_trunc('day', alert_date) AS day_start, alert_type, count(*) AS alerts, {dbl('sum(loss_amount)')} AS losses
FROM bronze_fraud_alerts
WHERE date_trunc('day', alert_date) + INTERVAL 1 DAY <= {_MARK.format(c='alert_date', t='bronze_fraud_alerts')}
GROUP BY 1, 2"""
_EVENT_MARK = _MARK.format(c="ts", t="events")
QUERIES["st_velocity_sliding"] = f"""
WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * s AS window_start, user_id,
    CAST(value AS DECIMAL(18,2)) AS v FROM events CROSS JOIN range(6) AS r(s))
SELECT window_start, user_id, count(*) AS events, {dbl('sum(v)')} AS amount FROM w
WHERE window_start + INTERVAL 1 HOUR <= {_EVENT_MARK} GROUP BY 1, 2 HAVING count(*) >= 3"""
QUERIES["st_sessions"] = f"""
WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS events,
  count(*) FILTER (event_type = 'error') AS errors
FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 30 MINUTE <= {_EVENT_MARK}"""
QUERIES["st_dq_monitor"] = f"""
SELECT date_trunc('day', ts) AS day_start, count(*) AS rows_evaluated, count(user_id) AS user_present,
  count(*) FILTER (event_type IN {EVENT_TYPES}) AS known_type,
  count(*) FILTER (value BETWEEN 0 AND 50) AS value_in_range,
  count(json_extract_string(props, '$.k')) AS props_readable
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_EVENT_MARK} GROUP BY 1"""
