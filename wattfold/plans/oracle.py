"""The registered queries as SQL for an independent engine on the same tables."""

from __future__ import annotations

from wattfold.plans.queries import DAY, FLOOR_SHARES, MONTH_END, NOON, PART_NAMES, RANGE, REGISTERED, SILENT_HOURS, STREAM_KEEP, SUNDAY
from wattfold.sources.tables import METERS, VOTES

ORACLE: dict[str, str] = {}


# --- text helpers: rounding and exact sums, spelled out -------------------------------


def even(x: str, d: int = 0) -> str:
    """Round the exact value of ``x`` (a column), ties to even."""
    s, k = f"{10**d}e0", "134217729e0"
    p = f"({x} * {s})"
    low = f"floor({p})"
    head = f"({x} * {k} - ({x} * {k} - {x}))"
    error = f"(({head} * {s} - {p}) + ({x} - {head}) * {s})"
    return (
        f"(CASE WHEN {p} - {low} < 0.5e0 THEN {low} WHEN {p} - {low} > 0.5e0 THEN {low} + 1e0 "
        f"WHEN {error} < 0 THEN {low} WHEN {error} > 0 THEN {low} + 1e0 "
        f"WHEN {low} - 2e0 * floor({low} / 2e0) = 0 THEN {low} ELSE {low} + 1e0 END / {s})"
    )


def up(x: str, d: int = 0) -> str:
    s = f"{10**d}e0"
    p = f"(({x}) * {s})"
    return f"(CASE WHEN {p} - floor({p}) >= 0.5e0 THEN floor({p}) + 1e0 ELSE floor({p}) END / {s})"


def units(x: str, d: int = 3) -> str:
    return f"CAST(floor(({x}) * {10**d}e0 + 0.5e0) AS BIGINT)"


def mean(total: str, count: str, d: int = 3) -> str:
    return f"(CAST({total} AS DOUBLE) / ({10**d}e0 * CAST({count} AS DOUBLE)))"


def values(total: str, d: int = 3) -> str:
    return f"(CAST({total} AS DOUBLE) / {10**d}e0)"


def total(x: str, where: str = "true") -> str:
    """Sum of doubles without error before the last rounding."""
    p = "67108864"
    k = f"({x})"
    whole = f"CAST(floor({k}) AS BIGINT)"
    scaled = f"(({k} - floor({k})) * {p}e0)"
    high = f"CAST(floor({scaled}) AS BIGINT)"
    low = f"CAST(floor(({scaled} - floor({scaled})) * {p}e0) AS BIGINT)"
    w, h, l = (f"CAST(sum({part}) FILTER ({where}) AS BIGINT)" for part in (whole, high, low))
    h2 = f"({h} + {l} // {p})"
    return (
        f"(CAST({w} + {h2} // {p} AS DOUBLE) + CAST(({h2} % {p}) * {p} + {l} % {p} AS DOUBLE) / ({p}e0 * {p}e0))"
    )


def average(x: str, where: str = "true") -> str:
    return f"({total(x, where)} / CAST(count({x}) FILTER ({where}) AS DOUBLE))"


def listed(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


# --- shared relations -----------------------------------------------------------------

READ = "r AS (SELECT user_id AS bid, ts, value AS kw, event_type AS meter, event_id AS seq FROM events)"
CUR = READ + ", cur AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY bid ORDER BY ts DESC, seq DESC) = 1)"
MET = READ + (
    ", met AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY bid, meter ORDER BY ts DESC, seq DESC) = 1)"
)
BLD = (
    "bld AS (SELECT c_custkey AS bid, c_name AS name, c_mktsegment AS segment, n_name AS nation, r_name AS category "
    "FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"
)
CAMPUS = "c AS (SELECT o_orderdate AS ts, o_totalprice AS total_kw, o_custkey AS online, o_orderkey AS seq FROM orders)"
CYCLES = (
    "c AS (SELECT ts, CASE WHEN event_type <> 'purchase' THEN value ELSE 0e0 END AS total_kw, "
    "CAST(json_extract_string(props, '$.k') AS INTEGER) AS online, event_id AS seq FROM events)"
)
ATTR = (
    "attr AS (SELECT p_partkey AS bid, CASE WHEN p_size <= 40 THEN p_size END AS floors, "
    "CASE WHEN p_size > 5 THEN p_size + 1950 END AS year_built FROM part)"
)
EFF = CUR + ", " + ATTR + (
    ", e0 AS (SELECT cur.bid, kw, coalesce(floors, 3) AS floors, year_built, "
    "kw / CAST(coalesce(floors, 3) AS DOUBLE) AS raw FROM cur LEFT JOIN attr USING (bid)), "
    f"eff AS (SELECT *, {up('raw', 1)} AS kw_per_floor FROM e0)"
)
VOTE = (
    "v AS (SELECT 'b' || json_extract_string(props, '$.k') AS building, user_id AS voter, ts, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VOTES.items())
    + f" END AS vote, event_id AS seq FROM events WHERE event_type IN ({listed(VOTES)}))"
)


def tally(group: str, source: str = "v") -> str:
    return (
        f"(SELECT {group}, hot, ok, cold, total, CASE WHEN hot > ok AND hot > cold THEN 'too_hot' "
        f"WHEN cold > ok AND cold > hot THEN 'too_cold' ELSE 'ok' END AS status FROM (SELECT {group}, "
        "count(*) FILTER (vote = 'hot') AS hot, count(*) FILTER (vote = 'ok') AS ok, "
        f"count(*) FILTER (vote = 'cold') AS cold, count(*) AS total FROM {source} GROUP BY {group}))"
    )


SLOTS = VOTE + ", vs AS (SELECT *, time_bucket(INTERVAL '2 hours', ts) AS slot FROM v)"


def estimates(kw: str) -> str:
    def part(factor: str, d: int) -> str:
        return f"(SELECT {even('e', d)} FROM (SELECT {kw} * 24e0{factor} AS e))"

    on = f"{kw} IS NOT NULL AND {kw} <> 0"
    return (
        f"CASE WHEN {on} THEN CAST({part('', 0)} AS BIGINT) END AS est_daily_kwh, "
        f"CASE WHEN {on} THEN {part(' * 0.15e0', 2)} END AS est_daily_cost, "
        f"CASE WHEN {on} THEN {part(' * 0.21e0', 1)} END AS est_daily_co2_kg"
    )


# --- scans, cleaning, latest ----------------------------------------------------------

ORACLE["html_payload_quarantine"] = """
SELECT 'page-' || page_id AS payload, contains(lower(substr(html, 1, 200)), '<html') AS rejected FROM pages
UNION ALL SELECT 'text-' || doc_id, contains(lower(substr(text, 1, 200)), '<html') FROM documents"""

ORACLE["day_index"] = "SELECT DISTINCT CAST(ts AS DATE) AS date FROM events ORDER BY date"

ORACLE["meter_normalize"] = f"""
SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN '3' ELSE event_type END AS meter,
  {even('value', 3)} AS kw, {even('f', 3)} AS frequency,
  CASE WHEN event_type <> 'error' AND t <= 1e8 THEN {even('t', 3)} END AS thd_v1
FROM (SELECT *, value / 8e0 AS f, value * 1e6 AS t FROM events)"""

ORACLE["drop_error_rows"] = f"WITH {READ} SELECT bid, ts, kw, seq FROM r WHERE meter IN ('purchase', 'view')"

ORACLE["safe_float_clean"] = f"""
SELECT event_id AS seq, CASE WHEN event_type IN ('error', 'click') OR x > 1e8 THEN NULL ELSE {even('x', 3)} END AS kw
FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value * 1e7 ELSE value / 7e0 END AS x FROM events)"""

ORACLE["any_measure_present"] = """
SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN value END AS water_rate,
  CASE WHEN event_type = 'purchase' THEN value END AS steam_rate
FROM events WHERE event_type IN ('view', 'purchase')"""

ORACLE["kw_resolve_priority"] = f"""
SELECT event_id AS seq, {even('x', 1)} AS kw FROM (SELECT event_id, CASE
  WHEN event_type IN ('click', 'purchase') AND value > 0 AND value < 50000 THEN value
  WHEN event_type IN ('view', 'signup') AND value / 3e0 > 0 THEN value / 3e0
  WHEN value >= 100 AND value * 2e0 < 50000 THEN value * 2e0 END AS x FROM events)"""

ORACLE["daily_estimates"] = f"""
WITH {READ}, k AS (SELECT seq, CASE WHEN meter <> 'error' THEN kw END AS kw FROM r),
x AS (SELECT seq, kw, kw IS NOT NULL AND kw <> 0 AS on_line, kw * 24e0 AS kwh, kw * 24e0 * 0.15e0 AS cost, kw * 24e0 * 0.21e0 AS co2 FROM k)
SELECT seq, kw, CASE WHEN on_line THEN 'online' ELSE 'offline' END AS status,
  CASE WHEN on_line THEN CAST({even('kwh')} AS BIGINT) END AS est_daily_kwh,
  CASE WHEN on_line THEN {even('cost', 2)} END AS est_daily_cost,
  CASE WHEN on_line THEN {even('co2', 1)} END AS est_daily_co2_kg FROM x"""

ORACLE["meter_status"] = f"""
WITH {MET}, m AS (SELECT c_custkey AS bid, unnest([{listed(METERS)}]) AS meter FROM customer)
SELECT m.bid, m.meter, met.kw, CASE WHEN met.seq IS NULL THEN 'offline' ELSE 'online' END AS status
FROM m LEFT JOIN met ON m.bid = met.bid AND m.meter = met.meter"""

ORACLE["today_filter"] = f"WITH {READ} SELECT bid, ts, kw, seq FROM r WHERE CAST(ts AS DATE) = DATE '{DAY}'"

ORACLE["lookback_filter"] = f"""
WITH {READ} SELECT bid, ts, kw, seq FROM r
WHERE ts >= TIMESTAMP '{NOON}' - INTERVAL '48 hours' AND ts <= TIMESTAMP '{NOON}'"""

ORACLE["latest_per_meter"] = f"WITH {MET} SELECT bid, meter, ts, kw, seq FROM met"


def fallback(registry: str) -> str:
    return f"""
WITH {MET}, loads AS (SELECT bid AS mac, meter, CASE WHEN kw >= 20 THEN kw END AS kw, ts FROM met),
reg AS ({registry}),
tried AS (SELECT id, ordinal, name, mac, unnest(meters) AS meter, generate_subscripts(meters, 1) AS pos FROM reg),
j AS (SELECT t.*, l.kw, l.ts FROM tried t LEFT JOIN loads l ON t.mac = l.mac AND t.meter = l.meter)
SELECT id, replace(name, ' (Legacy)', '') AS name, mac, CASE WHEN kw IS NOT NULL THEN meter END AS meter, kw, ts FROM j
QUALIFY row_number() OVER (PARTITION BY id ORDER BY kw IS NULL, ordinal, CASE WHEN kw IS NULL THEN -pos ELSE pos END) = 1"""


ORACLE["meter_fallback"] = fallback(
    f"SELECT c_custkey AS id, 1 AS ordinal, c_name AS name, c_custkey AS mac, [{listed(METERS)}] AS meters FROM customer"
)
ORACLE["alias_fallback"] = fallback(
    "SELECT c_custkey AS id, 1 AS ordinal, c_name || ' (Legacy)' AS name, c_custkey AS mac, ['error'] AS meters FROM customer "
    "UNION ALL SELECT c_custkey, 2, c_name, c_custkey, ['purchase', 'view'] FROM customer"
)

ORACLE["offline_anti"] = """
SELECT c_custkey AS bid, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"""
ORACLE["online_semi"] = """
SELECT c_custkey AS bid, c_name AS name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)"""
ORACLE["silent_buildings"] = f"""
SELECT user_id AS bid, max(ts) AS last_ts FROM events GROUP BY user_id
HAVING max(ts) < TIMESTAMP '{MONTH_END}' - INTERVAL '24 hours'"""
ORACLE["registry_left_live"] = f"""
WITH {CUR}, {BLD} SELECT bld.bid, bld.name, cur.kw, cur.ts FROM bld LEFT JOIN cur USING (bid)"""

# --- ordered operators ----------------------------------------------------------------

ANOMALY = READ + f""", w AS (SELECT *, sum(CASE WHEN kw <> 0 THEN {units('kw')} END) OVER f AS t,
    count(CASE WHEN kw <> 0 THEN 1 END) OVER f AS n
  FROM r WINDOW f AS (PARTITION BY bid ORDER BY ts, seq ROWS 7 PRECEDING)),
a AS (SELECT *, CASE WHEN n >= 4 THEN {mean('t', 'n')} END AS m FROM w),
an AS (SELECT bid, ts, kw, seq, m, CASE WHEN m > 0 AND kw > m * 1.5e0 THEN 'high' WHEN m > 10 AND kw < m * 0.3e0 THEN 'low' END AS anomaly_type,
    CASE WHEN m <> 0 THEN kw / m END AS q FROM a)"""

ORACLE["anomaly_rolling"] = f"""
WITH {ANOMALY}, o AS (SELECT bid, ts, kw, seq, anomaly_type, CASE WHEN anomaly_type IS NOT NULL THEN {even('m', 1)} END AS avg_kw,
  CASE WHEN anomaly_type IS NOT NULL THEN {even('q', 2)} END AS ratio FROM an)
SELECT *, CAST({up('(ratio - 1e0) * 100e0')} AS BIGINT) AS deviation_pct FROM o"""

ORACLE["anomaly_time_range"] = f"""
WITH {READ}, k AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM r),
w AS (SELECT *, sum(CASE WHEN kw <> 0 THEN {units('kw')} END) OVER f AS t, count(CASE WHEN kw <> 0 THEN 1 END) OVER f AS n
  FROM k WINDOW f AS (PARTITION BY bid ORDER BY sec RANGE BETWEEN 216000 PRECEDING AND CURRENT ROW)),
a AS (SELECT *, CASE WHEN n >= 4 THEN {mean('t', 'n')} END AS m FROM w),
an AS (SELECT *, CASE WHEN m > 0 AND kw > m * 1.5e0 THEN 'high' WHEN m > 10 AND kw < m * 0.3e0 THEN 'low' END AS anomaly_type,
  CASE WHEN m <> 0 THEN kw / m END AS q FROM a)
SELECT bid, seq, anomaly_type, CASE WHEN anomaly_type IS NOT NULL THEN {even('m', 1)} END AS avg_kw,
  CASE WHEN anomaly_type IS NOT NULL THEN {even('q', 2)} END AS ratio FROM an"""

ORACLE["anomaly_count"] = f"""
WITH {ANOMALY}, l AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY bid ORDER BY ts DESC, seq DESC) = 1)
SELECT count(anomaly_type) AS anomaly_count, count(*) FILTER (anomaly_type = 'high') AS high,
  count(*) FILTER (anomaly_type = 'low') AS low FROM l"""

ORACLE["anomaly_map"] = f"""
WITH {ANOMALY}, l AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY bid ORDER BY ts DESC, seq DESC) = 1)
SELECT bid, anomaly_type AS type, kw AS current, {even('m', 1)} AS avg, {even('q', 2)} AS ratio FROM l WHERE anomaly_type IS NOT NULL"""

ORACLE["wma_forecast"] = f"""
WITH {READ}, w AS (SELECT bid, seq, kw, list(CASE WHEN kw <> 0 THEN {units('kw')} END) OVER
    (PARTITION BY bid ORDER BY ts, seq ROWS 3 PRECEDING) AS l FROM r),
z AS (SELECT bid, seq, kw, list_filter(l, lambda x: x IS NOT NULL) AS l FROM w),
s AS (SELECT bid, seq, kw, len(l) AS n, list_sum(list_transform(l, lambda x, i: x * i)) AS t FROM z),
p AS (SELECT *, {mean('t', 'n * (n + 1) / 2')} AS q FROM s)
SELECT bid, seq, kw, CASE WHEN n >= 2 THEN {even('q', 1)} END AS predicted_kw FROM p"""

LAST96 = READ + ", h AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY bid ORDER BY ts DESC, seq DESC) <= 96)"
ORACLE["history_96"] = f"WITH {LAST96} SELECT bid, ts, kw, seq FROM h"
ORACLE["series_last_96"] = f"WITH {LAST96} SELECT bid, ts, kw, seq FROM h WHERE meter <> 'error'"

SPARK = READ + """, d AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY ts DESC, seq DESC) AS back,
    count(*) OVER (PARTITION BY bid) AS n FROM r),
sp AS (SELECT bid, CAST(least(n, 24) - back AS INTEGER) AS i, CAST(back AS INTEGER) AS back, kw FROM d WHERE back <= 24)"""
ORACLE["sparkline_24"] = f"WITH {SPARK} SELECT bid, i, kw FROM sp"
ORACLE["sparkline_expand"] = f"""
WITH {SPARK} SELECT bid, TIMESTAMP '{MONTH_END}' - INTERVAL '15 minutes' * (back - 1) AS ts, kw FROM sp"""

FOLD = READ + """, fo AS (SELECT bid, strftime(ts, '%H:%M') AS label, kw FROM r
  QUALIFY row_number() OVER (PARTITION BY bid, strftime(ts, '%H:%M') ORDER BY ts, seq) = 1)"""
ORACLE["clock_fold"] = f"WITH {FOLD} SELECT * FROM fo"
ORACLE["snapshot_asof"] = f"""
WITH {READ} SELECT bid, ts, kw, seq FROM r WHERE ts <= TIMESTAMP '{NOON}'
QUALIFY row_number() OVER (PARTITION BY bid ORDER BY ts DESC, seq DESC) = 1"""
ORACLE["last_96_labels"] = "SELECT DISTINCT strftime(ts, '%H:%M') AS label FROM events ORDER BY label DESC LIMIT 96"
ORACLE["rank_by_kw"] = f"""
WITH {CUR}, {BLD} SELECT bld.bid, bld.name, cur.kw,
  row_number() OVER (ORDER BY coalesce(cur.kw, 0e0) DESC, bld.bid) AS rank FROM bld LEFT JOIN cur USING (bid)"""
ORACLE["positional_combine"] = f"""
WITH {READ}, p AS (SELECT kw, row_number() OVER (PARTITION BY meter ORDER BY ts, seq) AS position FROM r)
SELECT position, {total('kw')} AS combined_kw, count(kw) AS meters FROM p GROUP BY position"""
BUCKET = "time_bucket(INTERVAL '15 minutes', ts)"
ORACLE["bucket_combine"] = f"""
WITH {READ}, p AS (SELECT meter, {BUCKET} AS bucket, kw FROM r
  QUALIFY row_number() OVER (PARTITION BY meter, {BUCKET} ORDER BY ts DESC, seq DESC) = 1)
SELECT bucket, {total('kw')} AS combined_kw, count(kw) AS meters FROM p GROUP BY bucket"""

# --- rollups --------------------------------------------------------------------------


def stats(group: str) -> str:
    return f"""(SELECT {group}, current, {even('mn', 2)} AS min, {even('mx', 2)} AS max, {even('av', 2)} AS avg, count, peak_time
  FROM (SELECT {group}, arg_max(kw, ts) AS current, min(kw) AS mn, max(kw) AS mx,
    {average('kw')} AS av, count(kw) AS count FROM r GROUP BY {group}) s
  JOIN (SELECT {group}, ts AS peak_time FROM r QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY kw DESC, ts, seq) = 1) p
  USING ({group}))"""


ORACLE["series_stats"] = f"WITH {READ} SELECT * FROM {stats('bid')}"
ORACLE["shipment_stats"] = """
SELECT l_suppkey AS bid, min(l_quantity) AS min, max(l_quantity) AS max, count(l_quantity) AS count, max(l_shipdate) AS last_ts
FROM lineitem GROUP BY l_suppkey"""
ORACLE["campus_total"] = f"""
WITH {CUR}, t AS (SELECT {total('kw')} AS s, count(kw) AS buildings_online, count(*) AS buildings_total FROM cur),
k AS (SELECT {even('s', 1)} AS total_kw, buildings_online, buildings_total FROM t),
e AS (SELECT *, total_kw * 24e0 AS a, total_kw * 24e0 * 0.15e0 AS b, total_kw * 24e0 * 0.21e0 AS c FROM k),
f AS (SELECT total_kw, buildings_online, buildings_total, CAST({even('a')} AS BIGINT) AS total_daily_kwh,
  {even('b', 2)} AS total_daily_cost, {even('c', 1)} AS total_daily_co2_kg FROM e)
SELECT *, {up('total_daily_kwh / 1000e0', 1)} AS daily_mwh, CAST({up('total_daily_kwh / 30e0')} AS BIGINT) AS homes FROM f"""
ORACLE["meter_pivot_summary"] = f"""
WITH {READ}, l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY meter ORDER BY ts DESC, seq DESC) = 1),
s AS (SELECT {total('kw')} AS t, count(CASE WHEN kw <> 0 THEN 1 END) AS meters_online,
  {', '.join(f"max(CASE WHEN meter = '{m}' THEN kw END) AS kw_{m}" for m in METERS)} FROM l)
SELECT {even('t', 2)} AS total_kw_now, meters_online, {', '.join(f'kw_{m}' for m in METERS)} FROM s"""
ORACLE["category_rollup"] = f"""
WITH {CUR}, {BLD}, k AS (SELECT * FROM bld WHERE segment <> 'MACHINERY'),
g AS (SELECT coalesce(category, 'Other') AS category, {total('kw')} AS u FROM cur LEFT JOIN k USING (bid) GROUP BY 1),
a AS (SELECT sum(u) AS total FROM g), b AS (SELECT {even('total', 1)} AS total FROM a),
h AS (SELECT category, {up('u')} AS kw FROM g WHERE u > 0)
SELECT category, kw, CAST({up('kw / (SELECT total FROM b) * 100e0')} AS BIGINT) AS share_pct FROM h"""
ORACLE["kw_per_floor"] = f"""
WITH {EFF} SELECT bid, kw, floors, kw_per_floor,
  CASE WHEN kw_per_floor > 50 THEN 'high' WHEN kw_per_floor > 20 THEN 'mid' ELSE 'low' END AS efficiency_band FROM eff"""
ORACLE["avg_efficiency"] = f"""
WITH {EFF} SELECT {up(average('kw_per_floor'), 1)} AS avg_kw_per_floor, count(*) AS buildings FROM eff"""
ORACLE["age_vs_energy"] = f"WITH {EFF} SELECT bid, year_built, kw, floors, kw_per_floor FROM eff WHERE year_built IS NOT NULL"
ORACLE["load_band"] = """
SELECT event_id AS seq, CASE WHEN value > 200 THEN 'high' WHEN value > 100 THEN 'mid' ELSE 'low' END AS load_band,
  CASE WHEN value IS NULL OR value = 0 THEN 'none' WHEN value < 50 THEN 'low' WHEN value <= 200 THEN 'mid' ELSE 'high' END AS legend_band
FROM events"""
ORACLE["relative_band"] = f"""
WITH {CUR}, q AS (SELECT bid, kw, least(kw / (SELECT max(kw) FROM cur), 1e0) AS s FROM cur)
SELECT bid, kw, CASE WHEN kw = 0 THEN 'none' WHEN s < 0.15e0 THEN 'very_low' WHEN s < 0.35e0 THEN 'low'
  WHEN s < 0.55e0 THEN 'mid' WHEN s < 0.75e0 THEN 'high' ELSE 'very_high' END AS band FROM q"""
ORACLE["pf_normalize"] = "SELECT event_id AS seq, CASE WHEN abs(value) < 2 THEN value ELSE value / 100e0 END AS pf FROM events"
ORACLE["load_timeline"] = f"""
WITH {READ}, p AS (SELECT bid, {BUCKET} AS bucket, kw FROM r
  QUALIFY row_number() OVER (PARTITION BY bid, {BUCKET} ORDER BY ts DESC, seq DESC) = 1)
SELECT bucket, {up(total('kw'))} AS kw, count(kw) AS buildings FROM p GROUP BY bucket"""
ORACLE["load_timeline_folded"] = f"""
WITH {FOLD} SELECT label AS bucket, {up(total('kw'))} AS kw, count(kw) AS buildings FROM fo GROUP BY label"""


def daily(source: str) -> str:
    return f"""
WITH {source}, d AS (SELECT CAST(ts AS DATE) AS date, {average('total_kw', 'total_kw <> 0')} AS av, max(total_kw) AS mx, min(CASE WHEN total_kw <> 0 THEN total_kw END) AS mn,
    count(*) AS readings_count, sum(online) FILTER (online <> 0) AS os, count(*) FILTER (online <> 0) AS oc FROM c GROUP BY 1),
p AS (SELECT CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS peak_time FROM c WHERE total_kw <> 0
  QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY total_kw DESC, ts, seq) = 1),
m AS (SELECT d.*, peak_time, CAST(os AS DOUBLE) / CAST(oc AS DOUBLE) AS ao FROM d LEFT JOIN p USING (date)),
k AS (SELECT *, {even('av', 1)} AS avg_kw FROM m), e AS (SELECT *, avg_kw * 24e0 AS x FROM k),
f AS (SELECT *, {even('x')} AS est_kwh FROM e), g AS (SELECT *, est_kwh * 0.15e0 AS ec, est_kwh * 0.21e0 AS eo FROM f)
SELECT date, avg_kw, {even('mx', 1)} AS peak_kw, peak_time, {even('mn', 1)} AS min_kw, readings_count,
  CAST(coalesce({even('ao')}, 0) AS BIGINT) AS avg_online, dayname(date) AS day, est_kwh, {even('ec', 2)} AS est_cost, {even('eo', 1)} AS est_co2_kg
FROM g"""


ORACLE["daily_summary"] = daily(CYCLES)
ORACLE["daily_summary_orders"] = daily(CAMPUS)
ORACLE["building_weekly"] = f"""
WITH {READ}, g AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, bid, {average('kw')} AS av,
  max(kw) AS mx, min(kw) AS mn, count(kw) AS readings FROM r WHERE kw > 0 GROUP BY 1, 2),
e AS (SELECT *, av * 24e0 * 7e0 AS k, av * 24e0 * 7e0 * 0.15e0 AS c, av * 24e0 * 7e0 * 0.21e0 AS o FROM g)
SELECT week, e.bid, {even('av', 1)} AS avg_kw, {even('mx', 1)} AS peak_kw, {even('mn', 1)} AS min_kw, readings,
  {even('k')} AS est_weekly_kwh, {even('c', 2)} AS est_weekly_cost, {even('o', 1)} AS est_weekly_co2_kg,
  coalesce(c_name, CAST(e.bid AS VARCHAR)) AS name FROM e LEFT JOIN customer ON c_custkey = e.bid"""


def week(group: str = "", where: str = "") -> str:
    lead = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""{CAMPUS}, x AS (SELECT *, CAST(ts AS DATE) AS d, CAST(date_trunc('week', ts) AS DATE) AS week FROM c {where}),
a AS (SELECT {lead}min(d) AS period_start, max(d) AS period_end, count(DISTINCT d) AS days, count(*) FILTER (total_kw <> 0) AS total_readings,
  {average('total_kw', 'total_kw <> 0')} AS av, max(total_kw) AS mx, min(total_kw) AS mn FROM x {by}),
k AS (SELECT *, {even('av', 1)} AS avg_kw FROM a), e AS (SELECT *, avg_kw * 24e0 * days AS y FROM k),
f AS (SELECT *, {even('y')} AS total_kwh FROM e),
g AS (SELECT *, total_kwh * 0.15e0 AS c1, total_kwh * 0.21e0 AS c2, total_kwh * 0.21e0 / 1000e0 AS c3, total_kwh * 0.21e0 / 21.7e0 AS c4 FROM f),
wk AS (SELECT {lead}period_start, period_end, days, total_readings, avg_kw, {even('mx', 1)} AS peak_kw, {even('mn', 1)} AS min_kw, total_kwh,
  {even('c1', 2)} AS total_cost, {even('c2', 1)} AS total_co2_kg, {even('c3', 2)} AS total_co2_tons, CAST({even('c4')} AS BIGINT) AS trees_equivalent FROM g)"""


ORACLE["campus_week"] = f"WITH {week('week')} SELECT * FROM wk"
ORACLE["campus_week_asof"] = (
    f"WITH {week(where=f'''WHERE ts >= DATE '{SUNDAY}' - 6 AND ts < DATE '{SUNDAY}' + 1''')} SELECT * FROM wk"
)
ORACLE["report_week_offset"] = f"""
WITH {week('week')} SELECT CAST(week + 6 AS DATE) AS report_date, avg_kw, total_kwh, total_readings FROM wk
WHERE CAST(week + 6 AS DATE) = DATE '{SUNDAY}' - 14"""
ORACLE["week_over_week"] = f"""
WITH {week('week')}, l AS (SELECT week, avg_kw, lag(avg_kw) OVER (ORDER BY week) AS prev_avg_kw FROM wk),
q AS (SELECT *, avg_kw - prev_avg_kw AS a, (avg_kw - prev_avg_kw) / prev_avg_kw * 100e0 AS b FROM l)
SELECT week, avg_kw, prev_avg_kw, {even('a', 1)} AS change_kw, {even('b', 1)} AS change_pct FROM q"""
ORACLE["cross_meter_peak"] = f"""
WITH {READ}, s AS {stats('meter')}, o AS (SELECT *, list_position([{listed(METERS)}], meter) AS ord FROM s),
t AS (SELECT * FROM o ORDER BY max DESC, ord LIMIT 1)
SELECT {up(total('current'))} AS total_kw, {up(total('avg'))} AS total_avg_kw,
  {up('max(o.max)')} AS peak_kw, (SELECT meter FROM t) AS peak_meter, (SELECT peak_time FROM t) AS peak_time FROM o"""
ORACLE["top10_kw"] = f"""
WITH {CUR}, t AS (SELECT bid, kw, kw * 24e0 * 0.15e0 AS c FROM cur ORDER BY kw DESC, bid LIMIT 10)
SELECT bid, kw, {even('c', 2)} AS est_daily_cost FROM t"""
ORACLE["top10_efficiency"] = f"WITH {EFF} SELECT bid, kw_per_floor FROM eff ORDER BY kw_per_floor DESC, bid LIMIT 10"
ORACLE["union_all_readings"] = """
SELECT bid, count(*) AS rows, count(seq) AS event_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM (
  SELECT user_id AS bid, ts, event_id AS seq FROM events UNION ALL SELECT l_suppkey, l_shipdate, NULL FROM lineitem) GROUP BY bid"""
ORACLE["union_distinct_labels"] = """
SELECT strftime(ts, '%H:%M') AS label FROM events UNION SELECT strftime(o_orderdate, '%H:%M') FROM orders"""

# --- baselines ------------------------------------------------------------------------


def cells(source: str = READ, name: str = "r") -> str:
    return source + f""", s AS (SELECT bid, CAST(isodow(ts) - 1 AS INTEGER) AS wday, CAST(hour(ts) AS INTEGER) AS hr,
    CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS wclass, {units('kw')} AS u FROM {name} WHERE kw IS NOT NULL),
g AS (SELECT bid, wday, wclass, hr, count(*) AS n, sum(u) AS su, sum(CAST(u AS HUGEINT) * CAST(u AS HUGEINT)) AS sq,
    CASE grouping_id(bid, wday, hr, wclass) WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 4 END AS tier
  FROM s GROUP BY GROUPING SETS ((bid, wday, hr), (bid, wclass, hr), (bid, hr), (bid))),
m AS (SELECT *, {mean('su', 'n')} AS a, sqrt(CAST(n * sq - su * su AS DOUBLE)) / (1000e0 * CAST(n AS DOUBLE)) AS b FROM g
  WHERE tier = 4 OR n >= 3),
ce AS (SELECT bid, tier, wday, wclass, hr, {even('a', 2)} AS mean, {even('b', 2)} AS std, n FROM m)"""


ORACLE["baseline_grouping_sets"] = f"WITH {cells()} SELECT * FROM ce"
ORACLE["baseline_shipments"] = (
    f"WITH {cells('r AS (SELECT l_suppkey AS bid, l_shipdate AS ts, l_quantity AS kw FROM lineitem)')} SELECT * FROM ce"
)
for _tier, _cols in {1: "wday, hr, ", 2: "wclass, hr, ", 3: "hr, ", 4: ""}.items():
    ORACLE[f"baseline_tier{_tier}"] = f"WITH {cells()} SELECT bid, {_cols}mean, std, n FROM ce WHERE tier = {_tier}"
COVER = cells() + f""", q AS (SELECT bid, max(CASE WHEN tier = 4 THEN n END) AS samples,
  {', '.join(f'count(*) FILTER (tier = {t}) AS tier{t}_cells' for t in (1, 2, 3))} FROM ce GROUP BY bid),
z AS (SELECT *, {', '.join(f'tier{t}_cells / {full}e0 * 100e0 AS p{t}' for t, full in ((1, 168), (2, 48), (3, 24)))} FROM q)"""
ORACLE["baseline_coverage"] = f"""
WITH {COVER} SELECT bid, samples, tier1_cells, tier2_cells, tier3_cells,
  {', '.join(f"{even(f'p{t}', 1)} AS tier{t}_pct" for t in (1, 2, 3))} FROM z"""
ORACLE["coverage_top5"] = f"WITH {COVER} SELECT bid, samples FROM z ORDER BY samples DESC, bid LIMIT 5"
ORACLE["forecast_lookup"] = f"""
WITH {cells()}, t AS (SELECT seq, bid, ts + INTERVAL '5 days' AS ts FROM r),
j AS (SELECT t.seq, t.bid, t.ts, ce.tier, ce.mean, ce.std, ce.n FROM t LEFT JOIN ce ON ce.bid = t.bid AND (
    (ce.tier = 1 AND ce.wday = isodow(t.ts) - 1 AND ce.hr = hour(t.ts))
    OR (ce.tier = 2 AND ce.wclass = CASE WHEN isodow(t.ts) >= 6 THEN 'weekend' ELSE 'weekday' END AND ce.hr = hour(t.ts))
    OR (ce.tier = 3 AND ce.hr = hour(t.ts)) OR ce.tier = 4))
SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY seq ORDER BY tier) = 1"""

# --- dimensions -----------------------------------------------------------------------

_exact = " ".join(f"WHEN nm = '{k}' THEN '{v}'" for k, v in PART_NAMES.items())
_loose = " ".join(f"WHEN contains(nm, '{k}') OR contains('{k}', nm) THEN '{v}'" for k, v in PART_NAMES.items())
ORACLE["short_name"] = f"""
WITH p AS (SELECT p_partkey, p_name || CASE WHEN p_size > 25 THEN ' Hall' ELSE ' Center' END AS nm FROM part)
SELECT p_partkey, CASE {_exact} {_loose} ELSE regexp_replace(regexp_replace(nm, ' Hall$', ''), ' Center$', '') END AS short_name,
  CASE {_exact} ELSE regexp_replace(regexp_replace(nm, ' Hall', ''), ' Center', '') END AS simple_name FROM p"""
ORACLE["nice_name"] = """
SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'The Red Widget' ELSE
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS nice_name FROM part"""
ORACLE["floor_allocation"] = f"""
WITH {READ}, sh(floor, meter, pct) AS (VALUES {', '.join(f"('{f}', '{m}', {round(s * 100)})" for f, m, s in FLOOR_SHARES)})
SELECT CAST(ts AS DATE) AS date, floor, {values(f'sum({units("kw")} * pct)', 5)} AS kw
FROM r JOIN sh USING (meter) GROUP BY 1, 2"""
ORACLE["shared_meter_check"] = """
SELECT c_nationkey AS mac, c_mktsegment AS meter, count(DISTINCT c_custkey) AS buildings, min(c_custkey) AS first_id,
  max(c_custkey) AS last_id FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_custkey) > 1"""

# --- votes ----------------------------------------------------------------------------

ORACLE["vote_tally"] = f"WITH {SLOTS} SELECT * FROM {tally('slot, building', 'vs')}"
ORACLE["vote_tally_asof"] = f"""
WITH {VOTE}, l AS (SELECT * FROM v WHERE ts > TIMESTAMP '{NOON}' - INTERVAL '2 hours' AND ts <= TIMESTAMP '{NOON}')
SELECT * FROM {tally('building', 'l')}"""
ORACLE["vote_overview"] = f"""
WITH {SLOTS} SELECT slot, CAST(sum(total) AS BIGINT) AS total_votes, count(*) AS buildings,
  count(*) FILTER (status = 'too_hot') AS hot_buildings, count(*) FILTER (status = 'too_cold') AS cold_buildings
FROM {tally('slot, building', 'vs')} GROUP BY slot"""
ORACLE["vote_shares"] = f"""
WITH {VOTE}, s AS (SELECT building, total, {up('hot / CAST(total AS DOUBLE) * 100e0')} AS hot_pct,
  {up('ok / CAST(total AS DOUBLE) * 100e0')} AS ok_pct FROM {tally('building')})
SELECT *, 100e0 - hot_pct - ok_pct AS cold_pct FROM s"""
ORACLE["recent_feed"] = f"""
WITH {VOTE}, t AS (SELECT building FROM v GROUP BY building ORDER BY count(*) DESC, building DESC LIMIT 1)
SELECT building, ts, vote, seq FROM v WHERE building = (SELECT building FROM t) ORDER BY ts DESC, seq DESC LIMIT 15"""
ORACLE["vote_cooldown"] = f"""
WITH RECURSIVE {VOTE}, o AS (SELECT voter, seq, ts, row_number() OVER (PARTITION BY voter ORDER BY ts, seq) AS i FROM v),
w AS (SELECT voter, seq, i, ts AS last, true AS accepted FROM o WHERE i = 1
  UNION ALL SELECT o.voter, o.seq, o.i, CASE WHEN o.ts >= w.last + INTERVAL '600 minutes' THEN o.ts ELSE w.last END,
    o.ts >= w.last + INTERVAL '600 minutes' FROM w JOIN o ON o.voter = w.voter AND o.i = w.i + 1)
SELECT voter, seq, accepted FROM w"""

# --- chat -----------------------------------------------------------------------------

MARK = r"(?i)<{1,2}\s*(ZOOM|FILTER|RESET|TREND)\s*(?::\s*([^<>\n]+?))?\s*>{1,2}"
REPLIES = """re AS (SELECT conv_id, turn, role, text || chr(10) || '<<ZOOM: ' || n_name || ' >>' ||
  CASE WHEN turn = 1 THEN chr(10) || '<filter:ASIA>>' WHEN turn = 2 THEN '<<FILTER:Nowhere>>' ELSE ' <<TREND>> ' END ||
  CASE WHEN role = 'user' THEN '<<Reset>>' ELSE '' END AS text FROM conversations LEFT JOIN nation ON conv_id % 25 = n_nationkey)"""
ACTIONS = REPLIES + f""", ex AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{MARK}', 1)) AS k,
    unnest(regexp_extract_all(text, '{MARK}', 2)) AS a, generate_subscripts(regexp_extract_all(text, '{MARK}', 1), 1) AS i FROM re),
ac AS (SELECT conv_id, turn, lower(k) AS type, CASE WHEN lower(k) <> 'reset' THEN nullif(trim(a), '') END AS arg, i FROM ex),
va AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS pos, type, arg
  FROM ac WHERE type = 'reset' OR arg IS NOT NULL)"""
ORACLE["chat_lang"] = """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'ko' WHEN turn > 2 THEN 'fr' ELSE 'en' END AS lang FROM conversations"""
ORACLE["chat_actions"] = f"WITH {ACTIONS} SELECT * FROM va"
ORACLE["chat_clean"] = f"""
WITH {REPLIES} SELECT conv_id, turn, coalesce(nullif(regexp_replace(regexp_replace(text, '{MARK}', '', 'g'), '^\\s+|\\s+$', '', 'g'), ''),
  'No answer came back; ask again in other words.') AS answer FROM re"""
ORACLE["action_whitelist"] = f"""
WITH {ACTIONS} SELECT * FROM va WHERE type = 'reset'
  OR (type = 'zoom' AND arg IN (SELECT n_name FROM nation WHERE n_regionkey <> 1))
  OR (type = 'filter' AND arg IN (SELECT r_name FROM region))"""
ORACLE["chat_history_clip"] = """
SELECT conv_id, turn, role, substr(text, 1, 1200) AS text FROM (SELECT * FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8)
WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> ''"""
ORACLE["chat_clip"] = """
SELECT conv_id, turn, substr(repeat(text, 3), 1, 2000) AS question, substr(repeat(text, 6), 1, 6000) AS context
FROM conversations WHERE role <> 'system' AND coalesce(text, '') <> ''"""


# --- streams: the batch answers -------------------------------------------------------

ORACLE["stream_verdicts"] = f"""
WITH x AS ({ORACLE["anomaly_rolling"]}), y AS ({ORACLE["wma_forecast"]})
SELECT x.bid, x.seq, x.kw, anomaly_type, avg_kw, ratio, predicted_kw FROM x JOIN y USING (seq)"""
ORACLE["stream_day_totals"] = f"""
WITH {READ}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day_start, bid, count(CASE WHEN kw <> 0 THEN 1 END) AS readings,
  {average('kw', 'kw <> 0')} AS av, max(CASE WHEN kw <> 0 THEN kw END) AS peak_kw,
  min(CASE WHEN kw <> 0 THEN kw END) AS min_kw FROM r GROUP BY 1, 2)
SELECT day_start, bid, readings, {even('av', 1)} AS avg_kw, peak_kw, min_kw FROM d"""
ORACLE["stream_vote_tally"] = f"""
WITH {VOTE}, vs AS (SELECT building, vote, strftime(time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes' * k, '%Y-%m-%d %H:%M') AS slot
  FROM v, (SELECT unnest(range(8)) AS k)) SELECT * FROM {tally('slot, building', 'vs')}"""
ORACLE["stream_cooldown"] = ORACLE["vote_cooldown"]
ORACLE["vote_cooldown_cut"] = ORACLE["vote_cooldown"]
ORACLE["stream_history"] = f"""
WITH {READ} SELECT bid, seq, kw FROM r WHERE kw IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY bid ORDER BY ts DESC, seq DESC) <= {STREAM_KEEP}"""
ORACLE["stream_silent"] = f"""
WITH {READ}, y AS ({ORACLE["wma_forecast"]}),
e AS (SELECT bid, ts, seq FROM r WHERE kw IS NOT NULL AND ts <= TIMESTAMP '{MONTH_END}'
  UNION ALL SELECT c_custkey, TIMESTAMP '{REGISTERED}', NULL FROM customer),
n AS (SELECT *, lead(ts) OVER (PARTITION BY bid ORDER BY ts, seq NULLS FIRST) AS next FROM e)
SELECT n.bid, strftime(ts + INTERVAL {SILENT_HOURS} HOURS, '%Y-%m-%d %H:%M:%S') AS offline_at, n.seq, predicted_kw
FROM n LEFT JOIN y ON n.seq = y.seq
WHERE ts + INTERVAL {SILENT_HOURS} HOURS <= TIMESTAMP '{MONTH_END}' AND coalesce(next > ts + INTERVAL {SILENT_HOURS} HOURS, true)"""
ORACLE["buildings_by_votes"] = f"""
WITH {VOTE} SELECT row_number() OVER (ORDER BY total DESC, building) AS rank, building, total, status FROM {tally('building')}"""
ORACLE["rank_by_average"] = f"""
SELECT bid, avg_kw, est_weekly_kwh, row_number() OVER (ORDER BY avg_kw DESC, bid) AS rank FROM (
  WITH {READ}, g AS (SELECT bid, {average('kw')} AS av FROM r WHERE kw > 0 GROUP BY 1), e AS (SELECT *, av * 24e0 * 7e0 AS k FROM g)
  SELECT bid, {even('av', 1)} AS avg_kw, {even('k')} AS est_weekly_kwh FROM e)"""
ORACLE["day_order"] = f"""
SELECT date, avg_kw, est_kwh, row_number() OVER (ORDER BY date) AS position FROM ({daily(CYCLES)})"""
ORACLE["daily_store"] = f"""
WITH {READ} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, bid, seq, CASE WHEN CAST(ts AS DATE) = DATE '{DAY}' THEN kw * 2e0 ELSE kw END AS kw
FROM r WHERE CAST(ts AS DATE) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'"""
ORACLE["snapshot_quarantine"] = f"""
WITH {READ}, h AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS hour, count(DISTINCT bid) AS n FROM r GROUP BY 1),
k AS (SELECT *, hour(hour) + 24 * day(hour) AS number FROM h),
p AS (SELECT *, CASE WHEN number % 5 = 0 THEN 'unreadable' WHEN number % 7 = 0 THEN 'no buildings'
  WHEN number % 11 = 0 THEN 'no time' END AS problem FROM k)
SELECT strftime(hour, '%Y-%m-%d-%H') AS snap, problem, CASE WHEN problem IS NULL THEN CAST(n AS INTEGER) END AS buildings FROM p"""
ORACLE["sharded_document"] = f"WITH {CUR} SELECT CAST(bid AS VARCHAR) AS bid, kw, meter FROM cur"
GAPPY = """r AS (SELECT CASE WHEN user_id <> 3 THEN user_id END AS bid, CASE WHEN user_id = 5 THEN date_trunc('day', ts)
  WHEN event_id % 50 <> 0 THEN ts END AS ts, value AS kw, event_type AS meter, event_id AS seq FROM events)"""
_READ_ORDER, _NULL_ORDER = "PARTITION BY bid ORDER BY ts, seq", "PARTITION BY bid ORDER BY ts NULLS FIRST, seq"
ORACLE["position_hot_cut"] = f"WITH {GAPPY} SELECT bid, seq, row_number() OVER ({_NULL_ORDER}) AS position FROM r"
ORACLE["anomaly_hot_cut"] = f"""
WITH x AS ({ORACLE["anomaly_rolling"]}), y AS ({ORACLE["wma_forecast"]})
SELECT x.bid, x.seq, anomaly_type, avg_kw, ratio, predicted_kw FROM x JOIN y USING (seq)""".replace(READ, GAPPY).replace(_READ_ORDER, _NULL_ORDER)


def _dates_as_text(name: str, *cols: str) -> None:
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)
    ORACLE[name] = f"SELECT * REPLACE ({casts}) FROM ({ORACLE[name]})"


for _name, _dates in {
    "day_index": ["date"],
    "daily_summary": ["date"],
    "daily_summary_orders": ["date"],
    "building_weekly": ["week"],
    "campus_week": ["week", "period_start", "period_end"],
    "campus_week_asof": ["period_start", "period_end"],
    "report_week_offset": ["report_date"],
    "week_over_week": ["week"],
    "floor_allocation": ["date"],
    "day_order": ["date"],
}.items():
    _dates_as_text(_name, *_dates)
