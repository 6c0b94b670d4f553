"""DuckDB SQL that computes the same results as the named queries."""

from __future__ import annotations

from flowloom import surrogates as S
from flowloom.catalogue import (
    CLUSTERS,
    HELD_OUT_BELOW,
    INTERVAL_NS,
    LLOYD_STEPS,
    METRICS_ALLOWED,
    PAGERANK_ROUNDS,
    POLLED,
    RECORDS,
    SCORE_WEIGHTS,
    SVM_STEPS,
)
from flowloom.config import POLLED_FEATURES
from flowloom.operators.events import DIRECT_RECORDS, PROBE_RECORD, SAMPLED_RECORDS

HOST = S.SURROGATE.host_ip
GAP_NS = S.SURROGATE.flow_gap_us * 1000
KEY = "src_ip, src_port, dst_ip, dst_port"

EV = """
ev AS (
  SELECT event_id, epoch_us(ts) * 1000 AS ts_ns, user_id, event_type, value,
         CAST(round(value * 100) AS BIGINT) AS size,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""

PACKETS = (
    EV
    + f""",
packets AS (
  SELECT event_id AS ord, ts_ns, printf('%.6f', ts_ns / 1e9) AS raw, size,
    CASE WHEN event_id % 2 = 0 THEN '{HOST}' ELSE '10.0.0.' || (user_id % 4) END AS src_ip,
    CAST(CASE WHEN event_id % 2 = 0 THEN 40000 + user_id % 3 ELSE 443 END AS INTEGER) AS src_port,
    CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || (user_id % 4) ELSE '{HOST}' END AS dst_ip,
    CAST(CASE WHEN event_id % 2 = 0 THEN 443 ELSE 40000 + user_id % 3 END AS INTEGER) AS dst_port
  FROM ev)"""
)

PACKET_ROWS = """
SELECT ts_ns, raw AS timestamp_epoch_s, src_ip AS source_ip, src_port AS source_port,
       dst_ip AS destination_ip, dst_port AS destination_port, size AS packet_size
FROM packets WHERE size > 0"""

# The capture text carries seconds with six decimals, so nanoseconds are read back from it.
PARSED_ROWS = PACKET_ROWS.replace(
    "SELECT ts_ns,", "SELECT CAST(trunc(CAST(raw AS DOUBLE) * 1000000000) AS BIGINT) AS ts_ns,"
)

RUNS = (
    PACKETS
    + f""",
stepped AS (
  SELECT *, lag(ts_ns) OVER (PARTITION BY {KEY} ORDER BY ts_ns, ord) AS prev_ns,
         min(ord) OVER (PARTITION BY {KEY}) AS key_ord FROM packets),
numbered AS (
  SELECT *, sum(CASE WHEN prev_ns IS NULL OR ts_ns - prev_ns > {GAP_NS} THEN 1 ELSE 0 END)
         OVER (PARTITION BY {KEY} ORDER BY ts_ns, ord) AS seq FROM stepped),
runs AS (
  SELECT {KEY}, seq, min(key_ord) AS key_ord,
    arg_min(raw, ts_ns) AS start_time, arg_max(raw, ts_ns) AS end_time,
    min(ts_ns) AS start_ts_ns, max(ts_ns) AS end_ts_ns,
    count(*) AS packet_count, CAST(sum(size) AS BIGINT) AS total_size
  FROM numbered GROUP BY {KEY}, seq)"""
)

FLOWS = (
    RUNS
    + f""",
host_bytes AS (
  SELECT ts_ns,
    coalesce(sum(CASE WHEN dst_ip = '{HOST}' THEN size ELSE 0 END) OVER before, 0) AS b_in,
    coalesce(sum(CASE WHEN src_ip = '{HOST}' THEN size ELSE 0 END) OVER before, 0) AS b_out
  FROM packets
  WINDOW before AS (ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
host_at AS (SELECT ts_ns, min(b_in) AS b_in, min(b_out) AS b_out FROM host_bytes GROUP BY ts_ns),
flows AS (
  SELECT row_number() OVER (ORDER BY key_ord, start_ts_ns) - 1 AS flow_id, {KEY},
    start_time, end_time, start_ts_ns, packet_count, total_size,
    CAST(coalesce((start_ts_ns - lag(end_ts_ns) OVER (PARTITION BY {KEY} ORDER BY start_ts_ns)) // 1000, 0)
         AS BIGINT) AS gap_us,
    CAST(b_in AS BIGINT) AS neworkin, CAST(b_out AS BIGINT) AS neworkout
  FROM runs JOIN host_at ON runs.start_ts_ns = host_at.ts_ns)"""
)

POLLED_SQL = """
own_polled AS (
  SELECT CAST(1000 + user_id % 3 AS VARCHAR) AS pid,
    CASE event_type WHEN 'view' THEN 'vmrss_bytes' ELSE 'utime_ticks' END AS feature, ts_ns, value, event_id AS ord
  FROM ev WHERE event_type IN ('view', 'click')),
shared AS (
  SELECT 'memavailable_bytes' AS feature, ts_ns, value, event_id AS ord FROM ev WHERE event_type = 'error'),
polled AS (
  SELECT pid, feature, ts_ns, value, ord FROM own_polled
  UNION ALL
  SELECT p.pid, s.feature, s.ts_ns, s.value, s.ord
  FROM shared s, (SELECT DISTINCT pid FROM own_polled) p)"""

EVENT_SQL = """
evented AS (
  SELECT CAST(1000 + user_id % 4 AS VARCHAR) AS pid,
    CASE event_type WHEN 'purchase' THEN 'sendmsg' ELSE 'cpu_allocations' END AS feature,
    ts_ns, value, event_id AS ord
  FROM ev WHERE event_type IN ('purchase', 'signup'))"""


def _enriched(probes: str, polled: list[str], records: list[str]) -> str:
    """CTE ``feat``: every probe per pid with its latest samples."""
    sources = []
    if polled:
        sources.append("SELECT DISTINCT pid FROM own_polled")
    if records:
        sources.append("SELECT DISTINCT pid FROM evented")
    columns = [f"round(s_{f}.v, 6) AS {f}" for f in polled]
    joins = []
    for f in polled:
        joins.append((f, "polled"))
    for r in records:
        columns.append(f"round(s_{r}.v, 6) AS {r}")
        columns.append(f"round(greatest(0, (f.start_ts_ns - s_{r}.u) / 1e9), 6) AS tt_{r}_raw")
        joins.append((r, "evented"))
    columns = [
        c
        if not c.endswith("_raw")
        else f"CASE WHEN s_{c.split(' AS tt_')[1][:-4]}.u IS NOT NULL THEN {c.split(' AS ')[0]} END AS tt_{c.split(' AS tt_')[1][:-4]}"
        for c in columns
    ]
    text = "".join(
        f"""
  ASOF LEFT JOIN (SELECT pid, ts_ns AS u, arg_max(value, ord) AS v FROM {table} WHERE feature = '{name}'
                  GROUP BY pid, ts_ns) s_{name} ON f.pid = s_{name}.pid AND f.start_ts_ns >= s_{name}.u"""
        for name, table in joins
    )
    return f"""
pids AS ({' UNION '.join(sources)}),
fan AS (SELECT pids.pid, p.* FROM {probes} p, pids),
feat AS (SELECT f.*, {', '.join(columns)} FROM fan f{text})"""


SERIES = POLLED_SQL + "," + EVENT_SQL
FEATURES = FLOWS + "," + SERIES + "," + _enriched("flows", POLLED, RECORDS)
AGES = [f"tt_{r}" for r in RECORDS]
LAGGED = ["packet_count", "total_size", "gap_us", "neworkin", "neworkout", *POLLED]
for _r in RECORDS:
    LAGGED += [_r, f"tt_{_r}"]
LAGS = ", ".join(
    f"lag({c}, {j}) OVER w AS {c}_t{j}" for j in range(1, S.SURROGATE.history_k + 1) for c in LAGGED
)
LAG_WINDOW = f"WINDOW w AS (PARTITION BY pid, {KEY} ORDER BY start_ts_ns)"

LABELS = f"""
timed AS (
  SELECT *, CASE WHEN CAST(end_time AS DOUBLE) - CAST(start_time AS DOUBLE) > 0
                 THEN CAST(end_time AS DOUBLE) - CAST(start_time AS DOUBLE) END AS duration_s,
    lead(total_size) OVER (PARTITION BY src_ip ORDER BY start_ts_ns, src_port, dst_ip, dst_port) AS y_next_size
  FROM flows),
labelled AS (
  SELECT *, total_size * 8 / duration_s AS avg_rate_bps,
    CAST(coalesce(total_size * 8 / duration_s > {S.SURROGATE.elephant_bps!r}, false) AS INTEGER) AS y_is_elephant
  FROM timed)"""


def _interval(name: str, source: str, keys: str, double: bool = True) -> str:
    """CTEs stepping from one emission to the next event an interval later."""
    match = " AND ".join(f"e.{k} IS NOT DISTINCT FROM s.{k}" for k in keys.split(", "))
    extra = " + size" if double else ""
    return f"""
{name}_o AS (
  SELECT *, sum(size) OVER (PARTITION BY {keys} ORDER BY ts_ns, ord) AS total,
         row_number() OVER (PARTITION BY {keys} ORDER BY ts_ns, ord) AS rn FROM {source}),
{name}_s AS (
  SELECT {keys}, ts_ns, size, total, CAST(0 AS BIGINT) AS stamp, CAST(0 AS HUGEINT) AS before
  FROM {name}_o WHERE rn = 1
  UNION ALL
  SELECT {', '.join('n.' + k for k in keys.split(', '))}, n.ts_ns, n.size, n.total, n.prev, n.prev_total FROM (
    SELECT {', '.join('s.' + k for k in keys.split(', '))}, e.ts_ns, e.size, e.total, s.ts_ns AS prev, s.total AS prev_total,
      row_number() OVER (PARTITION BY {', '.join('s.' + k for k in keys.split(', '))} ORDER BY e.rn) AS pick
    FROM {name}_s s JOIN {name}_o e ON {match} AND e.ts_ns >= s.ts_ns + {INTERVAL_NS}) n WHERE pick = 1),
{name} AS (SELECT {keys}, stamp AS ts_ns, CAST(total - before{extra} AS BIGINT) AS size FROM {name}_s)"""


ALLOC = "alloc AS (SELECT user_id % 5 AS series, ts_ns, size, event_id AS ord FROM ev)"
COLLECTIVE = """collective AS (
  SELECT user_id % 5 AS series, ts_ns, event_id AS ord,
    CAST(size * CASE k % 7 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN 8 WHEN 5 THEN 2 ELSE 1 END
         AS BIGINT) AS size
  FROM ev)"""

WRITES = f"""WITH {EV},
log AS (
  SELECT ts_ns, user_id % 5 AS id, CASE event_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'error' ELSE 'click' END AS kind,
    size AS ret, event_id AS ord FROM ev),
spans AS (
  SELECT *,
    sum(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) OVER w AS enters,
    coalesce(sum(CASE WHEN kind = 'click' THEN 1 ELSE 0 END)
      OVER (PARTITION BY id ORDER BY ts_ns, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS exits
  FROM log WINDOW w AS (PARTITION BY id ORDER BY ts_ns, ord)),
flagged AS (
  SELECT *,
    max(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY id, exits) AS opened,
    max(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY id, exits, enters) AS sent,
    max(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY id, exits, enters) AS entered
  FROM spans)
SELECT id, ts_ns, ret AS size, ord FROM flagged
WHERE kind = 'click' AND opened = 1 AND entered = 1 AND sent = 1"""

PROBES = f"""
probes AS (
  SELECT {[*PROBE_RECORD, 'unlisted']!r}[1 + k % 9] AS probe, 1000 + user_id % 4 AS pid, ts_ns, size, event_id AS ord
  FROM ev),
named AS (
  SELECT CASE probe {' '.join(f"WHEN '{p}' THEN '{r}'" for p, r in PROBE_RECORD.items())} END AS record,
    CAST(pid AS VARCHAR) AS pid, ts_ns, size, ord FROM probes),
traced AS (SELECT DISTINCT pid FROM named)"""

SAMPLED_LIST = ", ".join(f"'{r}'" for r in SAMPLED_RECORDS if r != "cuda_allocations")
DIRECT_LIST = ", ".join(f"'{r}'" for r in DIRECT_RECORDS)
ROUTING = f"""WITH RECURSIVE {EV},{PROBES},
sampled_in AS (
  SELECT record, pid, ts_ns, size, ord FROM named WHERE record IN ({SAMPLED_LIST}) AND pid IN (SELECT pid FROM traced)
  UNION ALL
  SELECT record, NULL, ts_ns, size, ord FROM named WHERE record = 'cuda_allocations'),
{_interval('sampled', 'sampled_in', 'record, pid')}
SELECT record, pid, ts_ns, size FROM sampled WHERE pid IS NOT NULL
UNION ALL
SELECT s.record, t.pid, s.ts_ns, s.size FROM sampled s, traced t WHERE s.pid IS NULL
UNION ALL
SELECT record, pid, ts_ns, size FROM named WHERE record IN ({DIRECT_LIST}) AND pid IN (SELECT pid FROM traced)"""

SNAPSHOT = {
    "utime_ticks": "size",
    "stime_ticks": "k",
    "vmsize_bytes": "size * 1024",
    "vmrss_bytes": "user_id * 1024",
    "vmdata_bytes": "0",
    "disk_read_bytes": "size",
    "disk_write_bytes": "0",
}
# Snapshots of one (time, pid) are one row; event times are distinct.


def _metrics(features) -> str:
    return f"WITH {EV} " + " UNION ALL ".join(
        f"SELECT ts_ns, CAST(1000 + user_id % 3 AS INTEGER) AS pid, '{f}' AS feature, CAST({SNAPSHOT[f]} AS DOUBLE) AS value FROM ev"
        for f in features
    )


def _pagerank() -> str:
    parts = [
        "e AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)",
        "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)",
        "d AS (SELECT src, count(*) AS outdeg FROM e GROUP BY src)",
        "r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM v)",
    ]
    for i in range(1, PAGERANK_ROUNDS + 1):
        parts.append(
            f"c{i} AS (SELECT e.dst AS id, sum(r.rank / d.outdeg) AS s FROM e JOIN d ON e.src = d.src "
            f"JOIN r{i - 1} r ON r.id = e.src GROUP BY e.dst)"
        )
        parts.append(
            f"r{i} AS (SELECT v.id, 0.15 + 0.85 * coalesce(c.s, 0) AS rank FROM v LEFT JOIN c{i} c ON v.id = c.id)"
        )
    last = f"r{PAGERANK_ROUNDS}"
    parts.append(
        f"ranks AS (SELECT id, rank * (SELECT count(*) / sum(rank) FROM {last}) AS exact FROM {last})"
    )
    return "WITH " + ",\n".join(parts)


VECTORS = "x AS (SELECT vec_id AS id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings)"
IMAGES = """images AS (
  SELECT vec_id, list_concat([vec_id // 65536 % 256, vec_id // 256 % 256, vec_id % 256],
    list_transform(embedding, lambda v: CAST(least(255, greatest(0, floor((v::DOUBLE + 4) * 32))) AS BIGINT))) AS pixels
  FROM embeddings)"""
PIXELS = f"""{IMAGES},
x AS (SELECT vec_id AS id, unnest(range({S.IMAGE_WIDTH})) AS d, unnest(pixels) / 255.0 AS v FROM images)"""


def _svm(held: str) -> str:
    """Unrolled gradient steps, then the area under the curve on the points held out."""
    parts = [
        VECTORS,
        f"y AS (SELECT vec_id AS id, CASE WHEN label % 2 = 1 THEN 1.0 ELSE -1.0 END AS y, {held} AS held FROM embeddings)",
        "t AS MATERIALIZED (SELECT x.*, y.y, (SELECT count(*) FROM y WHERE NOT held) AS n FROM x JOIN y USING (id) WHERE NOT held)",
        "w0 AS (SELECT DISTINCT d, 0.0::DOUBLE AS w FROM x)",
    ]
    for i in range(1, SVM_STEPS + 1):
        rate = f"(10.0::DOUBLE / sqrt({i}.0::DOUBLE))"
        parts.append(
            f"m{i} AS MATERIALIZED (SELECT t.id FROM t JOIN w{i - 1} w ON t.d = w.d GROUP BY t.id, t.y HAVING t.y * sum(t.v * w.w) < 1)"
        )
        parts.append(
            f"w{i} AS MATERIALIZED (SELECT w.d, w.w * (1 - {rate} * 0.01::DOUBLE) - {rate} * coalesce(g.g, 0) AS w FROM w{i - 1} w LEFT JOIN "
            f"(SELECT d, sum(-y * v) / max(n) AS g FROM t JOIN m{i} USING (id) GROUP BY d) g ON w.d = g.d)"
        )
    last = f"w{SVM_STEPS}"
    parts.append(
        f"scored AS (SELECT x.id, y.y, sum(x.v * w.w) AS s FROM x JOIN {last} w ON x.d = w.d JOIN y ON y.id = x.id "
        "WHERE y.held GROUP BY x.id, y.y)"
    )
    parts.append(
        "area AS (SELECT avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END::DOUBLE) AS v "
        "FROM scored a JOIN scored b ON a.y > b.y)"
    )
    return (
        f"WITH {', '.join(parts)} SELECT CAST(d AS BIGINT) AS place, round(w, 6) AS weight FROM {last} "
        "UNION ALL SELECT -1, round(v, 6) FROM area"
    )


def _lloyd(points: str = VECTORS) -> str:
    """Unrolled Lloyd steps over (id, dimension, value) rows."""
    parts = [
        points,
        f"m0 AS (SELECT id AS c, d, v FROM x WHERE id < {CLUSTERS})",
    ]
    for i in range(LLOYD_STEPS + 1):
        parts.append(
            f"g{i} AS (SELECT x.id, m.c, sum((x.v - m.v) * (x.v - m.v)) AS cost FROM x JOIN m{i} m ON x.d = m.d "
            f"GROUP BY x.id, m.c)"
        )
        parts.append(
            f"a{i} AS (SELECT id, arg_min(c, cost) AS c, min(cost) AS cost FROM g{i} GROUP BY id)"
        )
        parts.append(
            f"m{i + 1} AS (SELECT m.c, m.d, coalesce(n.v, m.v) AS v FROM m{i} m LEFT JOIN "
            f"(SELECT a.c, x.d, avg(x.v) AS v FROM a{i} a JOIN x ON x.id = a.id GROUP BY a.c, x.d) n "
            f"ON m.c = n.c AND m.d = n.d)"
        )
    return "WITH " + ",\n".join(parts)


LAST = f"a{LLOYD_STEPS}"
MARGIN = " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * {w}" for i, w in enumerate(SCORE_WEIGHTS))

QUESTIONS = """
said AS (
  SELECT conv_id, turn, role, CASE
    WHEN role = 'user' AND conv_id % 3 = 0 THEN '  ' || text || ' ' || chr(10)
    WHEN role = 'assistant' AND conv_id % 5 = 0 THEN ''
    WHEN role = 'assistant' AND conv_id % 5 = 1 THEN ' ' || text || '  '
    WHEN role = 'system' AND conv_id % 4 = 0
      THEN 'Cutting Knowledge Date: May' || chr(10) || 'Today Date: June' || chr(10) || chr(10) || text
    ELSE text END AS text FROM conversations),
turns AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
heads AS (SELECT conv_id, coalesce(max(text) FILTER (WHERE role = 'system'), '') AS context FROM said GROUP BY conv_id),
asked AS (
  SELECT regexp_replace(CAST(t.conv_id AS VARCHAR), '^\\s+|\\s+$', '', 'g') AS title,
    regexp_replace(h.context, '^\\s+|\\s+$', '', 'g') AS context,
    regexp_replace(t.text, '^\\s+|\\s+$', '', 'g') AS question,
    CASE WHEN next_role = 'assistant' THEN next_text END AS answer,
    CASE WHEN next_role = 'assistant' THEN 1 ELSE 0 END AS n_answers
  FROM turns t JOIN heads h ON t.conv_id = h.conv_id WHERE t.role = 'user'),
prompts AS (
  SELECT *, regexp_replace(replace(
    '<|im_start|>system' || chr(10) || '<Título>' || chr(10) || title || chr(10) || '</Título>' || chr(10)
    || '<Contexto>' || chr(10) || context || chr(10) || '</Contexto><|im_end|>' || chr(10)
    || '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10)
    || '<|im_start|>assistant' || chr(10), '<|begin_of_text|>', ''),
    'Cutting Knowledge Date:.*?\\nToday Date:.*?\\n\\n', '', 'gs') AS prompt
  FROM asked)"""

QA_TRAIN = f"""WITH {QUESTIONS}
SELECT prompt, CASE WHEN length(answer) > 0 THEN regexp_replace(answer, '^\\s+|\\s+$', '', 'g')
                    ELSE 'No responde' END || '<|im_end|>' AS completion
FROM prompts WHERE n_answers = 1"""

STREAM_PROBES = "probes AS (SELECT event_id AS flow_id, ts_ns AS start_ts_ns FROM ev)"

ORACLES: dict[str, str] = {
    "parse_capture": f"WITH {PACKETS} {PARSED_ROWS}",
    "packet_file": f"WITH {PACKETS} {PACKET_ROWS}",
    "flow_table": f"WITH {FLOWS} SELECT * FROM flows",
    "flow_file": f"WITH {FLOWS} SELECT * FROM flows",
    "flow_counters": f"""WITH {RUNS},
moves AS (
  SELECT src_ip AS ip, ts_ns, 0 AS i, size AS o FROM packets
  UNION ALL SELECT dst_ip, ts_ns, size, 0 FROM packets
  UNION ALL SELECT src_ip, start_ts_ns, 0, 0 FROM runs),
sums AS (
  SELECT ip, ts_ns, coalesce(sum(i) OVER w, 0) AS i, coalesce(sum(o) OVER w, 0) AS o FROM moves
  WINDOW w AS (PARTITION BY ip ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
known AS (SELECT ip, ts_ns, min(i) AS i, min(o) AS o FROM sums GROUP BY ip, ts_ns)
SELECT {KEY}, start_ts_ns, CAST(i AS BIGINT) AS neworkin, CAST(o AS BIGINT) AS neworkout
FROM runs JOIN known ON runs.src_ip = known.ip AND runs.start_ts_ns = known.ts_ns""",
    "running_bytes": f"""WITH {PACKETS},
moves AS (
  SELECT src_ip AS ip, ts_ns, 0 AS i, size AS o FROM packets
  UNION ALL SELECT dst_ip, ts_ns, size, 0 FROM packets)
SELECT DISTINCT ip, ts_ns,
  CAST(sum(i) OVER w AS BIGINT) AS in_cum, CAST(sum(o) OVER w AS BIGINT) AS out_cum
FROM moves WINDOW w AS (PARTITION BY ip ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "asof_polled": f"WITH {FLOWS},{POLLED_SQL},{_enriched('flows', POLLED, [])} SELECT pid, flow_id, {', '.join(POLLED)} FROM feat",
    "asof_events": f"WITH {FLOWS},{EVENT_SQL},{_enriched('flows', [], RECORDS)} SELECT pid, flow_id, {', '.join(RECORDS + AGES)} FROM feat",
    "features": f"WITH {FEATURES} SELECT * FROM feat",
    "missing_report": f"WITH {FEATURES}, counts AS ("
    + " UNION ALL ".join(
        f"SELECT pid, '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM feat GROUP BY pid"
        for c in POLLED + RECORDS
    )
    + """), have AS (SELECT DISTINCT pid, feature FROM polled UNION SELECT DISTINCT pid, feature FROM evented)
SELECT c.* FROM counts c JOIN have h ON c.pid = h.pid AND c.feature = h.feature WHERE missing > 0""",
    "flow_history": f"WITH {FEATURES} SELECT *, {LAGS} FROM feat {LAG_WINDOW}",
    "numeric_scan": """SELECT 'event_id' AS column_name, count(event_id) AS n_values FROM events
UNION ALL SELECT 'user_id', count(user_id) FROM events UNION ALL SELECT 'value', count(value) FROM events""",
    "flow_labels": f"WITH {FLOWS},{LABELS} SELECT flow_id, duration_s, avg_rate_bps, y_is_elephant, y_next_size FROM labelled",
    "full_dataset": f"""WITH {FEATURES},{LABELS},
hist AS (SELECT *, {LAGS} FROM feat {LAG_WINDOW})
SELECT h.*, l.duration_s, l.avg_rate_bps, l.y_is_elephant, l.y_next_size
FROM hist h JOIN labelled l ON h.flow_id = l.flow_id""",
    "pid_table": f"WITH {FEATURES} SELECT pid, flow_id, total_size, {', '.join(POLLED)} FROM feat",
    "series_table": f"""WITH {EV},{POLLED_SQL}
SELECT feature, pid, ts_ns, value FROM own_polled UNION ALL SELECT feature, 'system', ts_ns, value FROM shared""",
    "interval_sample": f"WITH RECURSIVE {EV}, {ALLOC}, {_interval('emitted', 'alloc', 'series')} SELECT * FROM emitted",
    "interval_exact": f"WITH RECURSIVE {EV}, {ALLOC}, {_interval('emitted', 'alloc', 'series', False)} SELECT * FROM emitted",
    "collective_sample": f"WITH RECURSIVE {EV}, {COLLECTIVE}, {_interval('emitted', 'collective', 'series')} SELECT * FROM emitted",
    "socket_writes": WRITES,
    "event_routing": ROUTING,
    "cpu_only_routing": f"""WITH {EV},{PROBES}
SELECT record, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM named
WHERE record IS NOT NULL AND record NOT IN ('cuda_allocations', 'cuda_collective') GROUP BY record""",
    "cache_allocations": f"WITH {EV} SELECT '1001' AS pid, ts_ns, size FROM ev WHERE 1000 + user_id % 4 = 1001",
    "sent_sizes": f"""WITH {EV} SELECT ts_ns, (1000 + user_id % 4) * 4294967296 + user_id AS id, size - 600 AS size
FROM ev WHERE 1000 + user_id % 4 = 1002 AND size - 600 > 32""",
    "metrics_unpivot": _metrics(METRICS_ALLOWED),
    "system_memory": f"WITH {EV} SELECT ts_ns, CAST(size * 1024 AS DOUBLE) AS value FROM ev",
    "series_pivot": f"""WITH {EV},{POLLED_SQL},
every AS (SELECT pid, feature, ts_ns, value FROM own_polled UNION ALL SELECT 'system', feature, ts_ns, value FROM shared)
SELECT pid, ts_ns, max(value) FILTER (WHERE feature = 'memavailable_bytes') AS memavailable_bytes,
  max(value) FILTER (WHERE feature = 'utime_ticks') AS utime_ticks,
  max(value) FILTER (WHERE feature = 'vmrss_bytes') AS vmrss_bytes FROM every GROUP BY pid, ts_ns""",
    "workload_series": f"""WITH {EV},{SERIES},
every AS (SELECT pid, 'polled' AS kind, feature, ts_ns FROM own_polled
          UNION ALL SELECT pid, 'event', feature, ts_ns FROM evented)
SELECT pid, kind, feature, count(*) AS n, max(ts_ns) AS last_ns FROM every
WHERE pid IN ('1000', '1001') GROUP BY pid, kind, feature""",
    "edge_file": "SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS copies FROM lineitem GROUP BY 1, 2",
    "graph_degrees": """WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)
SELECT v.id, count(e.src) AS outdeg FROM v LEFT JOIN e ON v.id = e.src GROUP BY v.id""",
    "pagerank": f"{_pagerank()} SELECT id, round(exact, 6) AS rank FROM ranks",
    "pagerank_top": f"{_pagerank()} SELECT id, round(exact, 6) AS rank FROM ranks ORDER BY exact DESC, id DESC LIMIT 10",
    "kmeans_lloyd": f"{_lloyd()} SELECT id, c AS prediction, round(cost, 6) AS cost FROM {LAST}",
    "cluster_sizes": f"{_lloyd()} SELECT c AS prediction, count(*) AS count FROM {LAST} GROUP BY c",
    "wssse": f"{_lloyd()} SELECT round(sum(cost), 4) AS wssse FROM {LAST}",
    "svm_scores": f"""SELECT vec_id AS id, round({MARGIN} + 0.125, 9) AS margin,
  CASE WHEN {MARGIN} + 0.125 > 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS decision FROM embeddings""",
    "auroc": f"""WITH s AS (SELECT round({MARGIN}, 2) AS score, label % 2 AS label FROM embeddings),
r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS pos FROM s)
SELECT round((sum(pos) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label <> 1)), 9) AS auroc FROM r""",
    "qa_train": QA_TRAIN,
    "qa_eval": f"WITH {QUESTIONS} SELECT prompt, CAST(n_answers AS BIGINT) AS n_answers, coalesce(answer, '') AS answers FROM prompts",
    "qa_file": QA_TRAIN,
    "stream_packets": f"WITH {PACKETS} {PARSED_ROWS}",
    "stream_flows": f"WITH {RUNS} SELECT {KEY}, start_time, end_time, start_ts_ns, end_ts_ns, packet_count, total_size FROM runs",
    "stream_counters": f"""WITH {PACKETS},
moves AS (SELECT src_ip AS ip, 0 AS i, size AS o FROM packets UNION ALL SELECT dst_ip, size, 0 FROM packets)
SELECT ip, CAST(sum(i) AS BIGINT) AS bytes_in, CAST(sum(o) AS BIGINT) AS bytes_out FROM moves GROUP BY ip""",
    "stream_interval": f"WITH RECURSIVE {EV}, {ALLOC}, {_interval('emitted', 'alloc', 'series')} SELECT * FROM emitted",
    "stream_interval_keyed": f"WITH RECURSIVE {EV}, {ALLOC}, {_interval('emitted', 'alloc', 'series')} SELECT * FROM emitted",
    "stream_writes": WRITES,
    "stream_writes_keyed": WRITES,
    "stream_asof": f"WITH {EV}, {STREAM_PROBES},{SERIES},{_enriched('probes', POLLED, RECORDS)} "
    f"SELECT pid, flow_id, {', '.join(POLLED + RECORDS + AGES)} FROM feat",
    "stream_metrics": _metrics(POLLED_FEATURES),
    "stream_polled": f"WITH {EV},{POLLED_SQL} SELECT pid, 'polled' AS kind, feature, ts_ns, value FROM own_polled",
    "stream_events": f"WITH {EV},{EVENT_SQL} SELECT pid, 'event' AS kind, feature, ts_ns, value FROM evented",
}

_SHOWN = ", ".join(
    f"CASE WHEN {c} = floor({c}) THEN printf('%.0f', {c}) ELSE printf('%.6f', {c}) END AS {c}" for c in (*POLLED, *RECORDS)
)
_HOUR = 3_600_000_000_000

ORACLES |= {
    "svm_fit": _svm("vec_id % 5 = 0"),
    "svm_file": _svm(f"CAST(embedding[1] AS DOUBLE) < {HELD_OUT_BELOW}"),
    "stream_running_bytes": ORACLES["running_bytes"],
    "idx_file": f"""WITH {PIXELS}
SELECT id AS vec_id, round(sum(v), 6) AS total, round(sum(v * d), 6) AS weighted FROM x GROUP BY id""",
    "kmeans_file": f"""{_lloyd(PIXELS)}
SELECT c AS prediction, 3 * count(*) AS count, CAST(sum(3 * count(*)) OVER () AS BIGINT) AS images,
       round(sum(sum(cost)) OVER () * 3, 4) AS wssse FROM {LAST} GROUP BY c""",
    "pagerank_file": ORACLES["pagerank_top"],
    "pid_table_csv": f"WITH {FEATURES} SELECT pid, flow_id, {_SHOWN} FROM feat",
    "ordered_dataset": f"""WITH {FEATURES}
SELECT pid, {KEY}, start_ts_ns, row_number() OVER (PARTITION BY pid ORDER BY {KEY}, start_ts_ns) AS place FROM feat""",
    "tied_writes": WRITES.replace("SELECT ts_ns, user_id % 5 AS id", f"SELECT ts_ns // {_HOUR} * {_HOUR} AS ts_ns, user_id % 5 AS id"),
    "epoch_events": f"""WITH {EV} SELECT ts_ns, user_id % 5 AS id,
  CASE event_id % 3 WHEN 0 THEN 'enter' WHEN 1 THEN 'sock_sendmsg' ELSE 'exit' END AS kind, size AS ret FROM ev""",
    "signed_pids": f"WITH {EV} SELECT DISTINCT user_id % 50 AS pid FROM ev WHERE event_id % 3 <> 1 UNION SELECT 7777",
    "stream_series": ORACLES["series_table"],
    "stream_flows_append": ORACLES["stream_flows"],
    "stream_flow_counters": ORACLES["flow_counters"],
    "stream_routing": ORACLES["event_routing"],
    "stream_asof_keyed": ORACLES["stream_asof"],
}

# Cutting decides balance and never results.
ORACLES |= {
    f"{name}_cut": ORACLES[name]
    for name in (
        "flow_table flow_counters running_bytes features flow_history flow_labels full_dataset socket_writes pagerank auroc"
    ).split()
}
ORACLES |= {"interval_cut": ORACLES["interval_sample"], "dataset_from_files": ORACLES["full_dataset"]}
