"""DuckDB SQL that states the result of every registered query on the same tables.

The SQL builds each field of a log line straight from the event it was made of instead of parsing
lines, and walks rate limits line by line.
"""

from __future__ import annotations

NOW = "2024-02-01 00:00:00"

# Lines and their fields, from the events.
_LOGS = rf"""
base AS (
  SELECT event_id, ts, event_type, user_id, props,
    'src' || greatest(event_id % 6 - 1, 0) AS source,
    ['DEBUG','INFO','WARN','ERROR','CRIT','FATAL','notice','Warning'][(event_id // 6) % 8 + 1] AS word,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso,
    strftime(ts, '%b ') || lpad(day(ts)::VARCHAR, 2, ' ') || strftime(ts, ' %H:%M:%S') AS named
  FROM events),
shaped AS (
  SELECT *,
    row_number() OVER (PARTITION BY source ORDER BY event_id) AS line_number,
    CASE event_id % 5 WHEN 0 THEN iso WHEN 1 THEN iso WHEN 4 THEN '{NOW}' ELSE named END AS timestamp,
    CASE WHEN event_id % 5 IN (2, 3) THEN 'host' || user_id % 7 ELSE '' END AS hostname,
    CASE event_id % 5 WHEN 2 THEN 'app' WHEN 3 THEN 'kernel' ELSE '' END AS process,
    CASE WHEN event_id % 5 = 2 THEN event_id::VARCHAR ELSE '' END AS pid,
    CASE event_id % 5
      WHEN 0 THEN 'user ' || user_id || ' ' || props
      WHEN 1 THEN event_type || ' v=' || props
      WHEN 2 THEN event_type || ' ' || word
      WHEN 3 THEN event_type
      ELSE event_type || ' "quoted" \ ' || props END AS message
  FROM base),
lined AS (
  SELECT *, epoch_ms(ts) AS event_ms,
    CASE event_id % 5
      WHEN 0 THEN iso || ' [' || word || '] ' || message
      WHEN 1 THEN iso || ' ' || word || ' ' || message
      WHEN 2 THEN named || ' ' || hostname || ' app[' || pid || ']: ' || message
      WHEN 3 THEN named || ' ' || hostname || ' kernel: ' || message
      ELSE message END AS value
  FROM shaped),
ranked AS (
  SELECT *,
    CASE
      WHEN regexp_matches(upper(value), 'CRITICAL|FATAL|EMERG') THEN 4
      WHEN regexp_matches(upper(value), 'ERR') THEN 3
      WHEN regexp_matches(upper(value), 'WARN') THEN 2
      WHEN regexp_matches(upper(value), 'DEBUG') THEN 0
      WHEN event_id % 5 IN (0, 1) AND word = 'CRIT' THEN 4
      ELSE 1 END AS rank
  FROM lined),
logs AS (
  SELECT *, ['DEBUG','INFO','WARNING','ERROR','CRITICAL'][rank + 1] AS severity,
    CASE WHEN event_id % 5 = 4 THEN TIMESTAMP '{NOW}' ELSE date_trunc('second', ts) END AS event_time
  FROM ranked)"""

# Lines of the documents.
_DOCS = """
docs AS (
  SELECT doc_id::VARCHAR AS source, unnest(range(1, len(parts) + 1)) AS line_number, unnest(parts) AS value
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


def _logs(select: str, more: str = "") -> str:
    return f"WITH {_LOGS}{more}\n{select}"


def _docs(select: str, more: str = "") -> str:
    return f"WITH {_DOCS}{more}\n{select}"


_LINE = "source, line_number, value"


def _bucket(key: str, max_lines: int, window: int, burst: int) -> str:
    """Lines a token bucket keeps, by a walk over the lines of each key in turn."""
    cap = window * burst
    return f""",
queued AS (
  SELECT *, {key} AS bucket, row_number() OVER (
    PARTITION BY {key} ORDER BY event_ms, source, line_number) AS turn FROM logs),
slim AS MATERIALIZED (SELECT bucket, turn, event_ms FROM queued),
walk AS (
  SELECT bucket, turn, event_ms, {cap}::BIGINT - {window} AS tokens, TRUE AS kept
  FROM slim WHERE turn = 1
  UNION ALL
  SELECT s.bucket, s.turn, s.event_ms,
    CASE WHEN least({cap}, w.tokens + (s.event_ms - w.event_ms) * {max_lines}) >= {window}
      THEN least({cap}, w.tokens + (s.event_ms - w.event_ms) * {max_lines}) - {window}
      ELSE least({cap}, w.tokens + (s.event_ms - w.event_ms) * {max_lines}) END,
    least({cap}, w.tokens + (s.event_ms - w.event_ms) * {max_lines}) >= {window}
  FROM walk w JOIN slim s ON s.bucket = w.bucket AND s.turn = w.turn + 1),
limited AS (SELECT q.* FROM queued q JOIN walk w USING (bucket, turn) WHERE w.kept)"""


def _limited(select: str, *config, more: str = "") -> str:
    return f"WITH RECURSIVE {_LOGS}{_bucket(*config)}{more}\n{select}"


def _quoted(column: str) -> str:
    return f"'\"' || replace({column}, '\"', '\"\"') || '\"'"


def _json_text(column: str) -> str:
    return f"to_json({column})::VARCHAR"


def _entry_json(line_number: str = "line_number", host: str = "hostname", tags: str = "") -> str:
    return (
        f"'{{\"timestamp\":' || {_json_text('timestamp')} || ',\"severity\":' || {_json_text('severity')}"
        f" || ',\"source\":' || {_json_text('source')} || ',\"hostname\":' || {_json_text(host)}"
        f" || ',\"process\":' || {_json_text('process')} || ',\"line_number\":' || {line_number}"
        f" || ',\"message\":' || {_json_text('message')} || '{tags}}}'")


_PLAIN = ("timestamp || ' [' || severity || '] ' || CASE WHEN hostname <> '' THEN hostname || ' ' ELSE '' END"
          " || CASE WHEN process <> '' THEN process || ': ' ELSE '' END || message")
_SYSLOG_TAIL = ("'>1 ' || timestamp || ' ' || coalesce(nullif(hostname, ''), '-') || ' ' ||"
                " coalesce(nullif(process, ''), '-') || ' - - - ' || message")
_CSV = " || ',' || ".join(_quoted(c) for c in (
    "timestamp", "severity", "source", "hostname", "process", "message"))
_EXPORT_CSV = " || ',' || ".join(
    c if c == "line_number" else _quoted(c) for c in (
        "timestamp", "severity", "source", "hostname", "process", "line_number", "message"))

_PER_SOURCE = ("source", 1, 3_600_000, 3)
_PER_TYPE = ("event_type", 3, 7_200_000, 2)
_GLOBAL = ("1", 2, 1_800_000, 5)
_SPAN = "6 hours"

_COLLECTED = """,
collected AS (
  SELECT * FROM limited
  WHERE NOT regexp_matches(props_in_line, '"k": 9[0-9]}')
    AND (contains(lower(value), 'error') OR (event_id % 5 = 0)) AND rank >= 1)"""
_COLLECT_FIX = """,
limited AS (
  SELECT *, CASE WHEN event_id % 5 IN (0, 1, 4) THEN props ELSE '' END AS props_in_line FROM kept)"""
_COLLECT_JSON = _entry_json(host="'edge1'", tags=',"tags":{"dc":"a","env":"prod"}')


def _collector(select: str) -> str:
    bucket = _bucket(*_GLOBAL).replace("limited AS (", "kept AS (")
    return f"WITH RECURSIVE {_LOGS}{bucket}{_COLLECT_FIX}{_COLLECTED}\n{select}"


_INTERVALS = f"""
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS interval_start, lines,
  (sum(lines) OVER (ORDER BY start))::BIGINT AS total_lines,
  (sum(bytes) OVER (ORDER BY start))::BIGINT AS bytes_processed
FROM (
  SELECT time_bucket(INTERVAL '{_SPAN}', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS lines,
    sum(strlen(value)) AS bytes FROM logs GROUP BY 1)"""

# Lines a bucket of bytes keeps; a refused line takes what is left in it.
def _byte_bucket(key: str, max_bytes: int, window: int, burst: int) -> str:
    cap = window * burst
    now = f"least({cap}, w.tokens + (s.event_ms - w.event_ms) * {max_bytes})"
    return f""",
queued AS (
  SELECT *, {key} AS bucket, row_number() OVER (
    PARTITION BY {key} ORDER BY event_ms, source, line_number) AS turn FROM logs),
slim AS MATERIALIZED (SELECT bucket, turn, event_ms, strlen(value) * {window} AS need FROM queued),
walk AS (
  SELECT bucket, turn, event_ms, greatest({cap}::BIGINT - need, 0) AS tokens, need <= {cap} AS kept FROM slim WHERE turn = 1
  UNION ALL
  SELECT s.bucket, s.turn, s.event_ms, greatest({now} - s.need, 0), {now} >= s.need
  FROM walk w JOIN slim s ON s.bucket = w.bucket AND s.turn = w.turn + 1),
limited AS (SELECT q.* FROM queued q JOIN walk w USING (bucket, turn) WHERE w.kept)"""


_TOTALS = ("total_lines", "bytes_processed", "dropped_lines", "filtered_lines", "bytes_written")


def _groups(name: str, group: str, kept: str, written: str, text: str) -> str:
    """The five totals of every group of lines; ``kept`` are the lines past the limit, ``written`` those that come through."""
    return f"""{name} AS (
  SELECT {group} AS g, count(*) AS total_lines, sum(strlen(value))::BIGINT AS bytes_processed FROM logs GROUP BY 1),
{name}_kept AS (SELECT {group} AS g, count(*) AS n FROM {kept} GROUP BY 1),
{name}_written AS (
  SELECT {group} AS g, count(*) AS n, sum(strlen({text}) + 1)::BIGINT AS bytes FROM {written} GROUP BY 1),
totals AS (
  SELECT g, total_lines, bytes_processed, total_lines - coalesce(k.n, 0) AS dropped_lines,
    coalesce(w.n, 0) AS filtered_lines, coalesce(w.bytes, 0) AS bytes_written
  FROM {name} LEFT JOIN {name}_kept k USING (g) LEFT JOIN {name}_written w USING (g))"""


_SPANS = f"time_bucket(INTERVAL '{_SPAN}', ts, TIMESTAMP '1970-01-01')"
_RUNNING = ", ".join(f"(sum({n}) OVER (ORDER BY g))::BIGINT AS {{prefix}}{n}" for n in _TOTALS)
_INTERVAL_TOTALS = f"""
SELECT strftime(g, '%Y-%m-%d %H:%M:%S') AS interval_start, total_lines AS lines, {_RUNNING.format(prefix="")} FROM totals"""
_SLICES = "CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 0 WHEN ts < TIMESTAMP '2024-01-16' THEN 1 WHEN ts < TIMESTAMP '2024-01-23' THEN 2 ELSE 3 END"


def _collector_totals(group: str, select: str) -> str:
    return _collector(select).replace("\n" + select, ",\n" + _groups("grouped", group, "limited", "collected", _COLLECT_JSON) + "\n" + select)


_HITS_TO_LINES = """,
near AS (
  SELECT DISTINCT h.source, h.line_number + d.delta AS line_number
  FROM hits h, (SELECT unnest([{deltas}]) AS delta) d)"""

_LEVEL_JSON = """
  (SELECT '{' || string_agg('"' || severity || '":' || n, ',' ORDER BY rank) || '}'
   FROM (SELECT severity, rank, count(*) AS n FROM FROM_TABLE GROUP BY 1, 2))"""


def _written(rows: str) -> str:
    return f"coalesce(sum(strlen({_COLLECT_JSON}) + 1), 0)::BIGINT"


ORACLES: dict[str, str] = {
    "read_lines": _logs(f"SELECT {_LINE} FROM logs"),
    "read_multi": _logs(f"SELECT {_LINE} FROM logs"),
    "read_skip_missing": _logs(f"SELECT {_LINE}, 1::BIGINT AS missing FROM logs"),
    "parse_log": _logs(
        "SELECT source, line_number, timestamp, severity, hostname, process, pid, message,"
        " strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time FROM logs"),
    "parse_documents": _docs(f"""
SELECT source, line_number, '{NOW}' AS timestamp,
  CASE WHEN regexp_matches(upper(value), 'CRITICAL|FATAL|EMERG') THEN 'CRITICAL'
    WHEN contains(upper(value), 'ERR') THEN 'ERROR' WHEN contains(upper(value), 'WARN') THEN 'WARNING'
    WHEN contains(upper(value), 'DEBUG') THEN 'DEBUG' ELSE 'INFO' END AS severity,
  '' AS hostname, '' AS process, value AS message FROM docs"""),
    "severity_from_string": _logs("""
SELECT source, line_number, token,
  CASE token WHEN 'DEBUG' THEN 'DEBUG' WHEN 'INFO' THEN 'INFO' WHEN 'WARN' THEN 'WARNING'
    WHEN 'ERROR' THEN 'ERROR' WHEN 'CRIT' THEN 'CRITICAL' WHEN 'FATAL' THEN 'CRITICAL' END AS level,
  CASE token WHEN 'DEBUG' THEN 'DEBUG' WHEN 'INFO' THEN 'INFO' WHEN 'WARN' THEN 'WARNING'
    WHEN 'Warning' THEN 'WARNING' WHEN 'ERROR' THEN 'ERROR' WHEN 'CRIT' THEN 'CRITICAL'
    WHEN 'FATAL' THEN 'CRITICAL' END AS lower_level
FROM (SELECT source, line_number, CASE
    WHEN event_id % 5 < 2 THEN word
    WHEN event_type IN ('click', 'view') THEN event_type
    WHEN event_id % 5 = 2 THEN word ELSE '' END AS token FROM logs)"""),
    "severity_to_string": _logs("""
SELECT source, line_number, line_number % 7 - 1 AS rank,
  coalesce(list_extract(['DEBUG','INFO','WARNING','ERROR','CRITICAL'],
    CASE WHEN line_number % 7 BETWEEN 1 AND 5 THEN line_number % 7 END), 'UNKNOWN') AS level
FROM logs"""),
    "detect_severity": _docs("""
SELECT source, line_number,
  CASE WHEN regexp_matches(upper(value), 'CRITICAL|FATAL|EMERG') THEN 'CRITICAL'
    WHEN contains(upper(value), 'ERR') THEN 'ERROR' WHEN contains(upper(value), 'WARN') THEN 'WARNING'
    WHEN contains(upper(value), 'DEBUG') THEN 'DEBUG' ELSE 'INFO' END AS severity,
  CASE WHEN list_has_any(words, ['critical', 'fatal', 'emerg']) THEN 'CRITICAL'
    WHEN list_has_any(words, ['error', 'err']) THEN 'ERROR'
    WHEN list_has_any(words, ['warning', 'warn']) THEN 'WARNING'
    WHEN list_contains(words, 'debug') THEN 'DEBUG' ELSE 'INFO' END AS word_severity
FROM (SELECT *, regexp_split_to_array(lower(value), '[^a-z0-9_]+') AS words FROM docs)"""),
    "format_json": _logs(
        "SELECT source, line_number, "
        + _entry_json(tags=',"tags":{"app":"x\\"y","zone":"b"}') + " AS json FROM logs"),
    "format_plain": _logs(f"SELECT source, line_number, {_PLAIN} AS plain FROM logs"),
    "format_csv": _logs(f"SELECT source, line_number, {_CSV} AS csv FROM logs"),
    "format_syslog": _logs(
        f"SELECT source, line_number, '<' || (128 + rank) || {_SYSLOG_TAIL} AS syslog,"
        f" '<' || (128 + [7,6,4,3,2][rank + 1]) || {_SYSLOG_TAIL} AS syslog_rfc FROM logs"),
    "match_position": _docs("""
SELECT source, line_number, m AS match_text, strpos(value, m)::BIGINT AS match_start,
  length(m)::BIGINT AS match_length
FROM (SELECT *, regexp_extract(value, '[a-z]+err[a-z]*') AS m FROM docs) WHERE m <> ''"""),
    "parse_tags": _logs("""
SELECT source, line_number,
  '{"src":"' || source || '","type":"' || line_number || '=x"}' AS tags FROM logs"""),
    "filter_include": _logs(
        f"SELECT {_LINE} FROM logs WHERE contains(value, 'ERROR') OR contains(value, 'CRIT') OR process = 'kernel'"),
    "filter_exclude": _logs(
        f"SELECT {_LINE} FROM logs WHERE process <> 'kernel' AND NOT (event_id % 5 = 0 AND word = 'INFO')"),
    "filter_severity_set": _logs("""
SELECT source, line_number, rank >= 1 AS passes, rank = 3 AS passes_strict FROM logs"""),
    "filter_composite": _logs(f"""
SELECT {_LINE} FROM logs
WHERE NOT (process = 'app' AND event_id % 10 = 7) AND (contains(value, 'purchase') OR rank IN (2, 4))"""),
    "min_severity": _logs("SELECT source, line_number, rank::BIGINT AS rank FROM logs WHERE rank >= 2"),
    "invert_match": _logs(f"SELECT {_LINE} FROM logs WHERE event_id % 5 NOT IN (0, 3) AND rank >= 3"),
    "filter_lines": _logs(f"""
SELECT {_LINE} FROM logs WHERE event_type IN ('click', 'view') AND event_id % 5 <> 0 AND rank >= 2"""),
    "filter_json": _logs(f"""
SELECT source, line_number, {_entry_json()} AS json FROM logs
WHERE event_type = 'signup' AND event_id % 5 <> 0 AND rank >= 1"""),
    "search": _logs(f"SELECT {_LINE} FROM logs WHERE event_id % 5 IN (0, 2) AND rank >= 3"),
    "search_icase": _logs(
        f"SELECT {_LINE} FROM logs WHERE contains(lower(value), 'warning') OR contains(lower(value), 'debug')"),
    "search_entries": _logs("""
SELECT source, line_number, timestamp, severity, hostname, process, message FROM logs
WHERE contains(value, 'ERROR') OR contains(value, 'purchase')"""),
    "search_context": _docs("""
SELECT d.source, d.line_number, d.value,
  regexp_matches(lower(d.value), 'nterr|therr') AS is_match
FROM docs d SEMI JOIN near USING (source, line_number)""", """,
hits AS (SELECT source, line_number FROM docs WHERE regexp_matches(lower(value), 'nterr|therr'))"""
        + _HITS_TO_LINES.format(deltas="-2, -1, 0, 1, 2")),
    "search_context_csv": _logs(f"""
SELECT source, line_number, line_number || ',' || {_quoted('value')} || ',' ||
  CASE WHEN process = 'kernel' AND event_type = 'error' THEN 1 ELSE 0 END AS csv
FROM logs SEMI JOIN near USING (source, line_number)""", """,
hits AS (SELECT source, line_number FROM logs WHERE process = 'kernel' AND event_type = 'error')"""
        + _HITS_TO_LINES.format(deltas="-1, 0, 1")),
    "search_max_count": _logs(f"""
SELECT {_LINE} FROM logs WHERE event_id % 5 = 4 ORDER BY source, line_number LIMIT 25"""),
    "search_count": _docs("SELECT count(*) AS matches FROM docs WHERE NOT contains(value, 'the')"),
    "tail_n": _logs(f"""
SELECT {_LINE}, tail_pos FROM (
  SELECT {_LINE}, row_number() OVER (PARTITION BY source ORDER BY line_number) AS tail_pos FROM (
    SELECT {_LINE}, row_number() OVER (PARTITION BY source ORDER BY line_number DESC) AS back
    FROM logs WHERE (event_id % 5 = 0 OR contains(lower(value), 'app')) AND rank >= 2)
  WHERE back <= 10)"""),
    "limit_first": _logs(f"SELECT {_LINE} FROM logs ORDER BY source, line_number LIMIT 100"),
    "merge_sorted": _logs("""
SELECT row_number() OVER (ORDER BY timestamp, source DESC, line_number) AS seq,
  timestamp, source, line_number, value FROM logs"""),
    "merge_by_time": _logs("""
SELECT row_number() OVER (ORDER BY event_time, source DESC, line_number) AS seq,
  source, line_number, value FROM logs"""),
    "merge_unsorted": _logs("""
SELECT row_number() OVER (ORDER BY source DESC, line_number) AS seq,
  source, line_number, value FROM logs"""),
    "severity_counts": _logs("SELECT severity, count(*) AS lines FROM logs GROUP BY severity"),
    "source_counts": _logs("SELECT source, count(*) AS lines FROM logs GROUP BY source"),
    "host_counts": _logs("SELECT hostname, count(*) AS lines FROM logs WHERE hostname <> '' GROUP BY hostname"),
    "stats_summary": _docs("""
SELECT source, count(*) AS total_lines, sum(strlen(value))::BIGINT AS total_bytes,
  min(strlen(value))::BIGINT AS min_line_length, max(strlen(value))::BIGINT AS max_line_length,
  (sum(strlen(value)) // count(*))::BIGINT AS avg_line_length FROM docs GROUP BY source"""),
    "stats_total": _logs("""
SELECT count(*) AS total_lines, sum(strlen(value))::BIGINT AS total_bytes,
  min(strlen(value))::BIGINT AS min_line_length, max(strlen(value))::BIGINT AS max_line_length,
  (sum(strlen(value)) // count(*))::BIGINT AS avg_line_length FROM logs"""),
    "first_last_timestamp": _logs("""
SELECT DISTINCT source,
  first_value(timestamp) OVER (PARTITION BY source ORDER BY line_number) AS first_timestamp,
  first_value(timestamp) OVER (PARTITION BY source ORDER BY line_number DESC) AS last_timestamp
FROM logs"""),
    "severity_distribution": _logs("""
SELECT severity, count(*) AS lines, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM logs) AS pct
FROM logs GROUP BY severity"""),
    "hourly_distribution": _logs("""
SELECT CASE WHEN event_id % 5 = 4 THEN '00' ELSE strftime(ts, '%H') END AS hour, count(*) AS lines
FROM logs GROUP BY 1"""),
    "hourly_histogram": _logs("""
SELECT hour, lines, repeat('#', CASE WHEN peak > 0 THEN (lines * 40) // peak ELSE 0 END) AS bar
FROM (SELECT *, max(lines) OVER () AS peak FROM (
  SELECT lpad(h::VARCHAR, 2, '0') AS hour,
    (SELECT count(*) FROM logs WHERE hour(event_time) = h) AS lines
  FROM range(24) r(h)))"""),
    "command_counts": _logs("""
SELECT count(*) AS processed,
  count(*) FILTER (event_type = 'purchase' AND event_id % 5 <> 0 AND rank >= 3) AS matched FROM logs"""),
    "stats_file_json": _logs("""
SELECT source, '{"file":"' || source || '","total_lines":' || n || ',"total_bytes":' || bytes
  || ',"avg_line_length":' || bytes // n || ',"min_line_length":' || lo || ',"max_line_length":' || hi
  || ',"first_timestamp":"' || first_ts || '","last_timestamp":"' || last_ts
  || '","severity_counts":{' || levels || '},"hourly_distribution":{' || hours || '}}' AS json
FROM (SELECT source, count(*) AS n, sum(strlen(value)) AS bytes, min(strlen(value)) AS lo,
    max(strlen(value)) AS hi, arg_min(timestamp, line_number) AS first_ts,
    arg_max(timestamp, line_number) AS last_ts FROM logs GROUP BY source)
JOIN (SELECT source, string_agg('"' || severity || '":' || n, ',' ORDER BY rank) AS levels
  FROM (SELECT source, severity, rank, count(*) AS n FROM logs GROUP BY 1, 2, 3) GROUP BY 1) USING (source)
JOIN (SELECT source, string_agg('"' || hour || '":' || n, ',' ORDER BY hour) AS hours
  FROM (SELECT source, strftime(event_time, '%H') AS hour, count(*) AS n FROM logs GROUP BY 1, 2)
  GROUP BY 1) USING (source)"""),
    "stats_json": _collector(f"""
SELECT '{{"total_lines":' || (SELECT count(*) FROM logs)
  || ',"filtered_lines":' || (SELECT count(*) FROM collected)
  || ',"dropped_lines":' || ((SELECT count(*) FROM logs) - (SELECT count(*) FROM limited))
  || ',"bytes_processed":' || (SELECT sum(strlen(value)) FROM logs)
  || ',"bytes_written":' || (SELECT {_written('collected')} FROM collected)
  || ',"start_time":"{NOW}","last_update":"{NOW}","severity_counts":'
  || {_LEVEL_JSON.replace("FROM_TABLE", "collected")}
  || ',"source_counts":' || (SELECT '{{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}}'
    FROM (SELECT source, count(*) AS n FROM logs GROUP BY 1)) || '}}' AS json"""),
    "stats_json_parts": _collector(f"""
SELECT 0::BIGINT AS part, '{{"total_lines":' || (SELECT count(*) FROM logs)
  || ',"filtered_lines":' || (SELECT count(*) FROM collected)
  || ',"dropped_lines":' || ((SELECT count(*) FROM logs) - (SELECT count(*) FROM limited))
  || ',"bytes_processed":' || (SELECT sum(strlen(value)) FROM logs)
  || ',"bytes_written":' || (SELECT {_written('collected')} FROM collected)
  || ',"start_time":"{NOW}","last_update":"{NOW}","severity_counts":'
  || {_LEVEL_JSON.replace("FROM_TABLE", "collected")} || ',"source_counts":{{' AS json
UNION ALL
SELECT 1 + (place - 1) // 2, CASE WHEN place > 2 THEN ',' ELSE '' END || string_agg('"' || source || '":' || n, ',' ORDER BY source)
FROM (SELECT source, n, place, (place - 1) // 2 AS g FROM (
  SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) AS place FROM logs GROUP BY 1)) GROUP BY g, 1 + (place - 1) // 2, place > 2
UNION ALL SELECT 1::BIGINT << 62, '}}}}'"""),
    "interval_lines": _logs(_INTERVALS),
    "interval_stats": _collector_totals(_SPANS, _INTERVAL_TOTALS),
    "interval_stats_unlimited": _logs(_INTERVAL_TOTALS, """,
passing AS (SELECT * FROM logs WHERE event_id % 5 <> 0 AND event_type IN ('click', 'purchase') AND rank >= 2),
""" + _groups("grouped", _SPANS, "logs", "passing", _PLAIN)),
    "rate_limit_bytes": f"WITH RECURSIVE {_LOGS}{_byte_bucket('source', 100, 3_600_000, 400)}\nSELECT {_LINE} FROM limited",
    "rate_limit": _limited(f"SELECT {_LINE} FROM limited", *_PER_SOURCE),
    "rate_limit_window": _limited("SELECT source, line_number, event_type FROM limited", *_PER_TYPE),
    "rate_limit_global": _limited(f"SELECT {_LINE} FROM limited", *_GLOBAL),
    "collector_batch": _collector(f"SELECT source, line_number, {_COLLECT_JSON} AS output FROM collected"),
    "stream_collector_limited": _collector(
        f"SELECT source, line_number, {_COLLECT_JSON} AS output FROM collected"),
    "collector_counters": _collector(f"""
SELECT (SELECT count(*) FROM logs) AS total_lines,
  (SELECT sum(strlen(value))::BIGINT FROM logs) AS bytes_processed,
  (SELECT count(*) FROM logs) - (SELECT count(*) FROM limited) AS dropped_lines,
  count(*) AS filtered_lines, {_written('collected')} AS bytes_written FROM collected"""),
    "global_tags": _logs("""
SELECT source, line_number,
  '{"env":"prod","rack":"r=1","type":"' || event_type || '"}' AS tags FROM logs"""),
    "hostname_override": _logs("""
SELECT source, line_number, 'collector-7' AS hostname, hostname AS parsed_hostname FROM logs"""),
    "export_range": _logs("""
SELECT source, line_number, timestamp, message FROM logs
WHERE event_id % 5 < 2 AND ts >= TIMESTAMP '2024-01-05' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-09 12:00:00'"""),
    "export_range_by_time": _logs("""
SELECT source, line_number, timestamp, message FROM logs
WHERE event_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00'"""),
    **{f"export_{name}": _logs(f"""
SELECT source, line_number, {text} AS text FROM logs
WHERE event_id % 5 < 2 AND ts < TIMESTAMP '2024-01-20'
ORDER BY source, line_number LIMIT 500""") for name, text in (
        ("json", _entry_json()), ("csv", _EXPORT_CSV),
        ("plain", "timestamp || ' [' || severity || '] ' || message"))},
    "write_roundtrip": _logs("""
SELECT CASE WHEN event_id % 5 IN (2, 3) THEN '""" + NOW + """' ELSE timestamp END AS timestamp, severity,
  CASE WHEN event_id % 5 IN (2, 3) THEN timestamp || ' [' || severity || '] ' || hostname || ' '
    || process || ': ' || message ELSE message END AS message,
  count(*) AS lines FROM logs GROUP BY 1, 2, 3"""),
    "write_table_roundtrip": _logs("""
SELECT strftime(event_time, '%Y-%m-%d') AS date, source, line_number, severity, message FROM logs"""),
    "size_buckets": _logs("""
SELECT source, line_number, bytes_before, bytes_before // 4096 AS file_no FROM (
  SELECT source, line_number, (sum(strlen(value) + 1) OVER (PARTITION BY source ORDER BY line_number)
    - strlen(value) - 1)::BIGINT AS bytes_before FROM logs)"""),
    "retention_plan": _logs("""
SELECT date, lines, date IN (SELECT DISTINCT strftime(event_time, '%Y-%m-%d') FROM logs
  ORDER BY 1 DESC LIMIT 5) AS keep
FROM (SELECT strftime(event_time, '%Y-%m-%d') AS date, count(*) AS lines FROM logs GROUP BY 1)"""),
    "stream_tail": _logs("""
SELECT source, value FROM logs
WHERE (contains(lower(value), 'click') OR contains(lower(value), 'user')) AND rank >= 2"""),
    "stream_watch": _logs("SELECT source, value FROM logs WHERE rank >= 3"),
    "stream_replace": _logs("SELECT source, value FROM logs"),
    "stream_tail_then_follow": _logs("""
SELECT source, value FROM (
  SELECT source, value, ts, row_number() OVER (
    PARTITION BY source, ts < TIMESTAMP '2024-01-16' ORDER BY line_number DESC) AS back FROM logs)
WHERE ts >= TIMESTAMP '2024-01-16' OR back <= 25"""),
    "stream_collector": _logs(f"""
SELECT source, severity, {_PLAIN} AS output FROM logs
WHERE event_id % 5 <> 0 AND event_type IN ('click', 'purchase') AND rank >= 2"""),
    "stream_rate_limit": _limited(f"SELECT {_LINE} FROM limited", *_PER_SOURCE),
    "stream_stats": _collector_totals(_SPANS, _INTERVAL_TOTALS),
    "stream_interval_lines": _logs(_INTERVALS),
    "stream_counters": _collector_totals(_SLICES, f"""
SELECT g::BIGINT AS batch, {", ".join(_TOTALS)}, {_RUNNING.format(prefix="all_")} FROM totals"""),
}
