"""SQL twins of the named queries, for a second engine to check the results.

The statements are written from the meaning of each operator: windows where
the Spark side aggregates, CASE chains where it looks up, plain joins where it
splits keys.
"""

from __future__ import annotations

from stowage import fixed_values as V
from stowage.plans.queries import CAPACITY, CHECK_RULES
from stowage.sources.given_tables import _FOLDERS, _SUFFIXES, AS_OF, SNAPSHOT_AS_OF


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _case(selector: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {selector} {arms} ELSE '{values[-1]}' END"


_FILE_ID = "concat(l_orderkey,'-',l_partkey,'-',l_suppkey,'-',l_linenumber)"
_CATEGORY = "CASE " + " ".join(
    f"WHEN extension IN {_in(members)} THEN '{name}'"
    for name, members in V.CATEGORY_EXTENSIONS.items()
) + " ELSE 'other' END"


def _parts(source: str, name: str) -> str:
    """Path parts and category over a table with ``path``."""
    return f"""
{name}_a AS (SELECT *, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '/')
   AS directory, regexp_extract(path, '[^/]*$') AS filename FROM {source}),
{name}_b AS (SELECT *, nullif(lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)), '')
   AS extension FROM {name}_a),
{name} AS (SELECT *, {_CATEGORY} AS category FROM {name}_b)"""


RAW = f"""
raw AS (SELECT 'scan-1' AS scan_id, {_FILE_ID} AS file_id,
 concat('/vol', l_suppkey % 4, '/u', l_orderkey % 50, '/proj', l_orderkey % 97,
  {_case('(l_partkey + l_linenumber) % 12', _FOLDERS)}, '/f', {_FILE_ID},
  {_case('l_partkey % 10', _SUFFIXES)}) AS path,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes,
 l_shipdate AS modified_at,
 l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS accessed_at,
 l_orderkey % 50 + 1000 AS uid,
 CASE WHEN l_returnflag = 'R' THEN NULL ELSE concat('u', l_orderkey % 50) END AS owner,
 33024 + l_linenumber * 12 AS mode, l_returnflag AS flag, l_linestatus AS state,
 l_suppkey AS device, concat(l_orderkey, '-', l_linenumber) AS inode
 FROM lineitem)"""
INV = RAW + "," + _parts("raw", "inv")
PAGES = """
page_raw AS (SELECT 'scan-1' AS scan_id, CAST(page_id AS VARCHAR) AS file_id,
 regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?:/', '') AS path,
 strlen(html) AS size_bytes FROM pages),""" + _parts("page_raw", "page_inv")
SECOND = """
raw2 AS (SELECT 'scan-2' AS scan_id, file_id,
 CASE WHEN flag = 'A' THEN concat(path, '.bak') ELSE path END AS path,
 size_bytes + CASE WHEN state = 'O' THEN 1 ELSE 0 END AS size_bytes,
 CASE WHEN state = 'O' THEN modified_at + INTERVAL 1 DAY ELSE modified_at END AS modified_at
 FROM raw WHERE flag <> 'R')"""
CONTENT = """
content AS (SELECT 'scan-1' AS scan_id, CAST(doc_id AS VARCHAR) AS file_id,
 concat('/corpus/', source, '/', lang, '/d', doc_id, '.txt') AS path, '.txt' AS extension,
 CAST(strlen(text) AS BIGINT) AS size_bytes, text AS body, sha256(text) AS sha256,
 TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS modified_at
 FROM documents)"""
SECOND_CONTENT = CONTENT + """,
content2 AS (SELECT * REPLACE ('scan-2' AS scan_id, CASE WHEN contains(path, '/de/')
 THEN modified_at + INTERVAL 1 HOUR ELSE modified_at END AS modified_at) FROM content
 WHERE coalesce(NOT contains(path, '/fr/'), true)),
contents AS (SELECT * FROM content UNION ALL SELECT * FROM content2)"""
GROUPS = CONTENT + """,
hashed AS (SELECT * FROM content WHERE size_bytes >= 1024),
groups AS (SELECT scan_id, sha256 AS group_id, min(size_bytes) AS file_size_bytes,
 count(*) AS member_count, min(size_bytes) * (count(*) - 1) AS wasted_bytes,
 'unresolved' AS status FROM hashed GROUP BY 1, 2 HAVING count(*) > 1),
members AS (SELECT g.*, h.file_id, h.path, h.extension, h.size_bytes, h.modified_at
 FROM groups g JOIN hashed h ON h.sha256 = g.group_id)"""
DECIDED = GROUPS + """,
picks AS (SELECT h.sha256 AS group_id, h.file_id AS keep_file_id, l.doc_id AS decided_at
 FROM hashed h JOIN labels l ON CAST(l.doc_id AS VARCHAR) = h.file_id WHERE l.quality = 1),
last_pick AS (SELECT group_id, keep_file_id FROM (SELECT *, row_number() OVER
 (PARTITION BY group_id ORDER BY decided_at DESC, keep_file_id DESC) AS r FROM picks) WHERE r = 1),
resolved AS (SELECT m.scan_id, m.group_id, m.file_size_bytes, m.member_count, m.wasted_bytes,
 m.file_id, m.path, m.size_bytes,
 CASE WHEN p.keep_file_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS status,
 CASE WHEN m.file_id = p.keep_file_id THEN 1 ELSE 0 END AS is_keeper
 FROM members m LEFT JOIN last_pick p ON p.group_id = m.group_id)"""
REMOVABLE = DECIDED + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY file_id) AS r,
 max(is_keeper) OVER (PARTITION BY group_id) AS has_keeper FROM resolved),
removable AS (SELECT group_id, file_id, path, size_bytes FROM numbered
 WHERE CASE WHEN has_keeper = 1 THEN is_keeper = 0 ELSE r > 1 END)"""


def _days(column: str) -> str:
    return (
        f"coalesce(greatest(0e0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({column}))"
        " / 86400000000e0), 9999e0)"
    )


_PARTS_OF_PATH = "string_split(path, '/')"
SCORED = INV + f""",
aged AS (SELECT *, {_days('accessed_at')} AS days_access, {_days('modified_at')} AS days_modify
 FROM inv),
sigmoid AS (SELECT *, CASE WHEN days_access <= 0 AND days_modify <= 0 THEN 0e0 ELSE
 round(1e0 / (1e0 + exp(-0.015e0 * (days_access * 0.3e0 + days_modify * 0.7e0 - 180e0))), 4) END
 AS stale_score,
 CASE WHEN list_has_any({_PARTS_OF_PATH}, [{_in(V.ARTIFACT_DIRECTORIES)[1:-1]}]) THEN 1 ELSE 0 END
 AS is_artifact FROM aged),
scored AS (SELECT *, CASE WHEN stale_score >= 0.5e0 THEN 1 ELSE 0 END AS is_stale,
 CASE WHEN stale_score < 0.1e0 THEN 'active' WHEN stale_score < 0.5e0 THEN 'aging'
  WHEN stale_score < 0.85e0 THEN 'stale' ELSE 'archive_candidate' END AS tier,
 CASE WHEN is_artifact = 1 THEN 'low'
  WHEN category IN ('code', 'document') THEN
   CASE WHEN stale_score < 0.5e0 THEN 'high' WHEN stale_score < 0.8e0 THEN 'medium' ELSE 'low' END
  WHEN category IN ('archive', 'audio', 'video', 'data') THEN 'low'
  WHEN stale_score < 0.5e0 THEN 'medium' ELSE 'low' END AS risk_level
 FROM sigmoid)"""

_ANCESTORS = (
    "unnest(list_transform(range(0, CASE WHEN directory = '/' THEN 1 ELSE "
    "len(string_split(directory, '/')) END), lambda i: '/' || "
    "array_to_string(string_split(directory, '/')[2:i + 1], '/')))"
)
FOLDERS = INV + f""",
up AS (SELECT {_ANCESTORS} AS path, directory, size_bytes FROM inv),
fsum AS (SELECT path, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
 count(*) AS file_count FROM up GROUP BY 1),
fdirs AS (SELECT a.path, count(b.path) AS dir_count FROM fsum a LEFT JOIN
 (SELECT path, {_ANCESTORS.replace('directory', 'path')} AS above FROM fsum) b
 ON b.above = a.path AND b.path <> a.path GROUP BY 1),
folders AS (SELECT 'scan-1' AS scan_id, f.path,
 CASE WHEN f.path = '/' THEN '/' ELSE regexp_extract(f.path, '[^/]*$') END AS name,
 CASE WHEN f.path = '/' THEN NULL ELSE
  coalesce(nullif(regexp_extract(f.path, '^(.*)/[^/]*$', 1), ''), '/') END AS parent_path,
 CAST(CASE WHEN f.path = '/' THEN 0 ELSE length(f.path) - length(replace(f.path, '/', '')) END
  AS INTEGER) AS depth,
 f.total_size_bytes, f.file_count, d.dir_count FROM fsum f JOIN fdirs d ON d.path = f.path)"""


def _first_pattern(values: list) -> str:
    """The value of the first pattern that occurs with a prefix."""
    arms = " ".join(
        f"WHEN instr(path, '{row[0]}') > 2 THEN {value}"
        for row, value in zip(V.WORKSPACE_PATTERNS, values, strict=True)
    )
    return f"CASE {arms} END"


_P = V.WORKSPACE_PATTERNS
SPACES = INV + f""",
ruled AS (SELECT *, {_first_pattern([f"'{r[0]}'" for r in _P])} AS pattern,
 {_first_pattern([f"'{r[1]}'" for r in _P])} AS w_type,
 {_first_pattern([f"'{r[2]}'" for r in _P])} AS a_type,
 {_first_pattern([f"'{r[3]}'" for r in _P])} AS w_risk,
 {_first_pattern([str(int(r[4])) for r in _P])} AS w_safe,
 lower(regexp_extract(path, '\\.[^./]*$')) AS last_suffix FROM inv),
artifacts AS (SELECT file_id, path, size_bytes, modified_at,
 CASE WHEN pattern IS NULL THEN 1 ELSE 0 END AS is_model,
 CASE WHEN pattern IS NULL THEN regexp_extract(path, '^(.*)/[^/]*$', 1)
  ELSE left(path, instr(path, pattern) - 1) END AS root,
 coalesce(w_type, 'ml') AS workspace_type, coalesce(a_type, 'ml_model') AS artifact_type,
 coalesce(w_risk, 'medium') AS risk_level, coalesce(w_safe, 0) AS is_safe
 FROM ruled WHERE pattern IS NOT NULL OR last_suffix IN {_in(V.MODEL_EXTENSIONS)}),
spaces AS (SELECT root AS path, regexp_extract(root, '[^/]*$') AS name,
 CASE WHEN max(is_model) = 1 THEN 'ml'
  ELSE max_by(workspace_type, file_id) END AS workspace_type,
 CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
 CAST(sum(size_bytes) AS BIGINT) AS recoverable_bytes,
 CAST(sum(CASE WHEN is_safe = 1 THEN size_bytes ELSE 0 END) AS BIGINT) AS safe_recoverable_bytes,
 count(*) AS file_count, max(modified_at) AS last_modified_at
 FROM artifacts GROUP BY root),
active AS (SELECT *, CASE WHEN workspace_type IN ('docker', 'ml') THEN 'medium' ELSE 'low' END
 AS risk_level, coalesce(CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_modified_at))
 / 86400000000e0) AS INTEGER), 9999) AS days_inactive FROM spaces),
found AS (SELECT *, CASE WHEN days_inactive < 180 THEN 1 ELSE 0 END AS is_active FROM active)"""

DAILY = """
daily AS (SELECT CAST(user_id % 20 AS VARCHAR) AS volume_id, CAST(ts AS DATE) AS snapshot_date,
 CAST(sum(CAST(round(value * 100) AS BIGINT) * 10000) AS BIGINT) AS bytes, count(*) AS files
 FROM events GROUP BY 1, 2),
cumulated AS (SELECT *, CAST(sum(bytes) OVER w AS BIGINT) AS running,
 CAST(sum(files) OVER w AS BIGINT) AS file_count FROM daily
 WINDOW w AS (PARTITION BY volume_id ORDER BY snapshot_date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
snaps AS (SELECT volume_id, snapshot_date, CAST(1000000000000000 AS BIGINT) AS total_size_bytes,
 CASE WHEN CAST(volume_id AS INTEGER) >= 15 THEN bytes ELSE running END AS used_size_bytes,
 file_count, CAST(0 AS BIGINT) AS dir_count FROM cumulated)"""
SCANNED = DAILY + """,
gapped AS (SELECT * FROM snaps WHERE CAST(volume_id AS INTEGER) % 3 <> 1
 OR day(snapshot_date) NOT BETWEEN 6 AND 19),
scanned AS (SELECT *, 'scan-2' AS scan_id FROM gapped UNION ALL
 SELECT * REPLACE (used_size_bytes - 1000 AS used_size_bytes), 'scan-1' FROM gapped
 WHERE day(snapshot_date) % 4 = 2),
per_day AS (SELECT * FROM scanned QUALIFY row_number() OVER
 (PARTITION BY volume_id, snapshot_date ORDER BY scan_id DESC) = 1)"""
POINTS = DAILY + """,
points AS (SELECT volume_id AS series, CAST(date_diff('day', min(snapshot_date)
 OVER (PARTITION BY volume_id), snapshot_date) AS INTEGER) AS day_index,
 used_size_bytes AS bytes FROM snaps),
deltas AS (SELECT *, CASE WHEN dd > 0 THEN db / CAST(dd AS DOUBLE) END AS delta FROM (
 SELECT *, day_index - lag(day_index) OVER w AS dd, bytes - lag(bytes) OVER w AS db
 FROM points WINDOW w AS (PARTITION BY series ORDER BY day_index)))"""


def _outcome(growth: str, line: bool, confidence: str, r2: str, model: str, empty: str) -> str:
    """The result columns of one model as a SELECT over ``fit``."""
    ahead = (
        "slope * (last_day + {d}) + intercept" if line else f"current_bytes + {growth} * {{d}}"
    )

    def predicted(days: int) -> str:
        value = f"CAST(trunc({ahead.format(d=days)}) AS BIGINT)"
        return f"CASE WHEN {empty} THEN 0 ELSE greatest({value}, current_bytes) END"

    daily = f"CASE WHEN {empty} THEN 0e0 ELSE greatest(0e0, {growth}) END"
    left = (
        f"CASE WHEN NOT ({empty}) AND {growth} > 0 AND capacity_bytes > current_bytes THEN "
        f"CAST(trunc(least((capacity_bytes - current_bytes) / ({growth}), 99999e0)) AS BIGINT) END"
    )
    return f"""SELECT series, current_bytes, capacity_bytes, n, m, fit_r2, variation,
 '{model}' AS model_type, {daily} AS daily, {predicted(30)} AS p30, {predicted(90)} AS p90,
 {left} AS days_until_full,
 CASE WHEN {empty} THEN 0e0 ELSE {confidence} END AS confidence,
 CASE WHEN {empty} THEN 0e0 ELSE {r2} END AS r2 FROM fit"""


FIT = POINTS + """,
placed AS (SELECT *, count(delta) OVER (PARTITION BY series ORDER BY day_index
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i,
 count(delta) OVER (PARTITION BY series) AS m FROM deltas),
sums AS (SELECT series, count(*) AS n, max(m) AS m,
 sum(CAST(day_index AS HUGEINT)) AS sx, sum(CAST(bytes AS HUGEINT)) AS sy,
 sum(CAST(day_index AS HUGEINT) * bytes) AS sxy,
 sum(CAST(day_index AS HUGEINT) * day_index) AS sxx,
 var_pop(CAST(bytes AS DOUBLE)) AS var_y, min(bytes) AS min_y, max(bytes) AS max_y,
 max(day_index) AS last_day, max_by(bytes, day_index) AS current_bytes,
 sum(CASE WHEN delta IS NOT NULL AND m - i < 7 THEN delta END) AS window_sum,
 count(CASE WHEN delta IS NOT NULL AND m - i < 7 THEN 1 END) AS window_n,
 sum(delta * CASE WHEN i = 1 THEN pow(0.7e0, m - 1) ELSE 0.3e0 * pow(0.7e0, m - i) END
  ORDER BY day_index) AS smoothed,
 avg(delta) AS delta_mean, stddev_pop(delta) AS delta_dev FROM placed GROUP BY series),
caps AS (SELECT volume_id AS series, max(used_size_bytes) * 3 AS known FROM snaps
 WHERE CAST(volume_id AS INTEGER) % 2 = 0 GROUP BY 1),
line AS (SELECT s.*, coalesce(c.known, s.current_bytes * 2) AS capacity_bytes,
 CAST(n * sxx - sx * sx AS DOUBLE) AS bottom,
 CAST(n * sxy - sx * sy AS DOUBLE) / nullif(CAST(n * sxx - sx * sx AS DOUBLE), 0) AS slope
 FROM sums s LEFT JOIN caps c ON c.series = s.series),
fit AS (SELECT *, (CAST(sy AS DOUBLE) - slope * CAST(sx AS DOUBLE)) / n AS intercept,
 window_sum / window_n AS mean7,
 CASE WHEN min_y = max_y OR slope IS NULL THEN 0e0 ELSE
  least(1e0, slope * slope * bottom / (n * n) / nullif(var_y, 0)) END AS fit_r2,
 CASE WHEN coalesce(delta_mean, 0) = 0 THEN 0e0 ELSE delta_dev / abs(delta_mean) END AS variation
 FROM line)""" + ",\nlinear AS (" + _outcome(
    "slope", True, "round(least(0.95e0, fit_r2 * 0.7e0 + least(0.25e0, 0.01e0 * n)), 3)",
    "fit_r2", "linear_regression", "n < 2 OR slope IS NULL",
) + "),\nmoving AS (" + _outcome(
    "mean7", False, "least(0.75e0, 0.5e0 + 0.03e0 * window_n)", "0e0", "moving_average",
    "n < 3 OR m = 0",
) + "),\nsmoothing AS (" + _outcome(
    "smoothed", False, "least(0.8e0, 0.45e0 + 0.04e0 * n)", "0e0", "exponential_smoothing",
    "n < 3 OR m = 0",
) + """),
nothing AS (SELECT series, current_bytes, capacity_bytes, n, m, fit_r2, variation,
 'auto' AS model_type, 0e0 AS daily, 0 AS p30, 0 AS p90, CAST(NULL AS BIGINT) AS days_until_full,
 0e0 AS confidence, 0e0 AS r2 FROM fit),
auto AS (SELECT * FROM nothing WHERE n < 3
 UNION ALL SELECT * FROM moving WHERE n BETWEEN 3 AND 4
 UNION ALL SELECT * FROM smoothing WHERE n >= 5 AND fit_r2 < 0.85e0 AND variation > 0.5e0
 UNION ALL SELECT * FROM linear WHERE n >= 5 AND (fit_r2 >= 0.85e0 OR variation <= 0.5e0))"""
_TREND = """CASE WHEN {total} <= 0 OR {daily} <= 0 THEN 'stable'
 WHEN {daily} * 30 / {total} * 100 < 0.5e0 THEN 'stable'
 WHEN {daily} * 30 / {total} * 100 < 2 THEN 'slow_growth'
 WHEN {daily} * 30 / {total} * 100 < 5 THEN 'moderate_growth'
 WHEN {daily} * 30 / {total} * 100 < 10 THEN 'rapid_growth' ELSE 'critical_growth' END"""
_EXHAUSTED = (
    "CASE WHEN days_until_full > 0 THEN strftime(CAST(DATE '" + SNAPSHOT_AS_OF
    + "' + CAST(days_until_full AS INTEGER) AS TIMESTAMP), '%Y-%m-%d') END"
)


def _forecast(source: str) -> str:
    trend = _TREND.format(daily="daily", total="current_bytes")
    return f"""WITH {FIT} SELECT series, model_type, round(daily, 0) AS daily_growth_bytes,
 round(daily * 7, 0) AS weekly_growth_bytes, round(p30 / 1000e0, 0) AS predicted_kb_30d,
 round(p90 / 1000e0, 0) AS predicted_kb_90d, {_EXHAUSTED} AS exhaustion_date, days_until_full,
 round(confidence, 3) AS confidence, {trend} AS trend, round(r2, 6) AS r_squared,
 n AS data_points_used FROM {source}"""


def _bytes_text(n: str, terabytes: bool = False) -> str:
    """Bytes as text with one decimal, ties to even, in whole numbers."""
    arms = []
    units = [(1024**3, "GB"), (1024**2, "MB"), (1024, "KB")]
    if terabytes:
        units.insert(0, (1024**4, "TB"))
    for unit, label in units:
        ten = f"(({n}) * CAST(10 AS HUGEINT))"
        up = (
            f"CASE WHEN ({ten} % {unit}) * 2 > {unit} OR (({ten} % {unit}) * 2 = {unit} "
            f"AND ({ten} // {unit}) % 2 = 1) THEN 1 ELSE 0 END"
        )
        tenths = f"({ten} // {unit} + {up})"
        arms.append(
            f"WHEN ({n}) >= {unit} THEN concat({tenths} // 10, '.', {tenths} % 10, ' {label}')"
        )
    return f"CASE {' '.join(arms)} ELSE concat(CAST(({n}) AS BIGINT), ' B') END"


def _priority(n: str, low: bool) -> str:
    gib = 1024**3
    first = f"WHEN {n} >= {50 * gib} THEN 'critical'" if low else ""
    third = f"WHEN {n} >= {gib} THEN 'high'" if low else ""
    return (
        f"CASE {first} WHEN {n} >= {5 * gib} THEN 'high' {third} "
        f"WHEN {n} >= {gib // 2} THEN 'medium' ELSE 'low' END"
    )


# Documents and lineitems make one scan, as in the queries.
CONTEXT = SCORED + "," + GROUPS + "," + SPACES.removeprefix(INV + ",") + """,
c_dup AS (SELECT count(*) AS duplicate_groups,
 CAST(coalesce(sum(member_count), 0) AS BIGINT) AS duplicate_files,
 CAST(coalesce(sum(wasted_bytes), 0) AS BIGINT) AS wasted_bytes FROM groups),
c_ext AS (SELECT string_agg(extension, ',' ORDER BY n DESC, extension) AS top_extensions FROM (
 SELECT extension, count(*) AS n FROM members GROUP BY 1 ORDER BY n DESC, extension LIMIT 5)),
c_tier AS (SELECT
 CAST(sum(CASE WHEN tier = 'stale' THEN size_bytes ELSE 0 END) AS BIGINT) AS stale_bytes,
 count(CASE WHEN tier = 'stale' THEN 1 END) AS stale_count,
 CAST(sum(CASE WHEN tier = 'archive_candidate' THEN size_bytes ELSE 0 END) AS BIGINT)
  AS archive_bytes,
 count(CASE WHEN tier = 'archive_candidate' THEN 1 END) AS archive_count FROM scored),
by_type AS (SELECT workspace_type, count(*) AS n, CAST(sum(recoverable_bytes) AS BIGINT) AS b
 FROM found GROUP BY 1),
c_types AS (SELECT string_agg(concat(workspace_type, ':', n, ':', b), ',' ORDER BY workspace_type)
 AS by_type FROM by_type),
c_space AS (SELECT count(*) AS workspace_count,
 CAST(sum(recoverable_bytes) AS BIGINT) AS workspace_bytes,
 CAST(sum(safe_recoverable_bytes) AS BIGINT) AS workspace_safe_bytes,
 count(CASE WHEN is_active = 0 THEN 1 END) AS inactive_workspaces FROM found),
c_free AS (SELECT CAST(sum(size_bytes) AS BIGINT) AS free_storage,
 sum(size_bytes) / 100e0 AS daily_growth_bytes FROM inv),
c_large AS (SELECT string_agg(concat(path, ':', size_bytes), ',' ORDER BY size_bytes DESC, path)
 AS largest_files FROM (SELECT path, size_bytes FROM inv ORDER BY size_bytes DESC, path LIMIT 20)),
ctx AS (SELECT * FROM c_dup, c_ext, c_tier, c_types, c_space, c_free, c_large)"""


def _rec(
    source: str, key: str, category: str, priority: str, confidence: float, risk: str,
    size: str, count: str, where: str, values: dict[str, str], subject: str = "", paths: str = "''",
) -> str:
    import re

    def text(template: str) -> str:
        pieces = re.split(r"\{(\w+)\}", template)
        return "concat(" + ", ".join(
            values[p] if i % 2 else "'" + p.replace("'", "''") + "'"
            for i, p in enumerate(pieces) if p
        ) + ")"

    title, description, explanation = V.RECOMMENDATION_TEXTS[key]
    subject = subject or f"'{key}'"
    return f"""SELECT concat('scan-1/{category}/', {subject}) AS recommendation_id,
 'scan-1' AS scan_id, '{category}' AS category, {priority} AS priority,
 {text(title)} AS title, {text(description)} AS description, {text(explanation)} AS explanation,
 {confidence}e0 AS confidence, {risk} AS risk_level, CAST({size} AS BIGINT) AS recoverable_bytes,
 CAST({count} AS BIGINT) AS affected_count, {paths} AS affected_paths, 'pending' AS status
 FROM {source} WHERE {where}"""


_FULL_IN = "(free_storage / daily_growth_bytes)"
_REST = "greatest(workspace_bytes - workspace_safe_bytes, 0)"
_WHOLE = lambda e: f"CAST(trunc({e}) AS BIGINT)"
RECS = CONTEXT + ",\nrecs AS (" + "\nUNION ALL ".join([
    _rec("ctx", "growth_warning", "growth_warning",
         f"CASE WHEN {_FULL_IN} < 30 THEN 'critical' WHEN {_FULL_IN} < 90 THEN 'high' "
         "ELSE 'medium' END", 0.70,
         f"CASE WHEN {_FULL_IN} < 60 THEN 'high' ELSE 'medium' END", "0", "0",
         f"daily_growth_bytes > 0 AND free_storage > 0 AND {_FULL_IN} <= 180",
         {"days": _WHOLE(_FULL_IN), "monthly": _bytes_text(_WHOLE("daily_growth_bytes * 30")),
          "free": _bytes_text("free_storage"), "daily": _bytes_text(_WHOLE("daily_growth_bytes"))}),
    _rec("ctx", "duplicates", "duplicate_cleanup", _priority("wasted_bytes", True), 0.95, "'low'",
         "wasted_bytes", "duplicate_files", "duplicate_groups > 0 AND wasted_bytes >= 102400",
         {"groups": "duplicate_groups", "wasted": _bytes_text("wasted_bytes"),
          "extensions": "coalesce(replace(top_extensions, ',', ', '), 'various')"}),
    _rec("ctx", "regenerable", "workspace_cleanup", _priority("workspace_safe_bytes", True), 0.97,
         "'low'", "workspace_safe_bytes", "workspace_count", "workspace_safe_bytes > 10485760",
         {"safe": _bytes_text("workspace_safe_bytes")}),
    _rec("ctx", "abandoned", "workspace_cleanup", _priority(_REST, False), 0.80, "'medium'",
         _REST, "inactive_workspaces", "inactive_workspaces >= 2",
         {"inactive": "inactive_workspaces"}),
    _rec("by_type", "workspace_type", "workspace_cleanup", "'high'", 0.90,
         "CASE WHEN workspace_type IN ('node', 'python', 'java', 'rust') THEN 'low' "
         "ELSE 'medium' END", "b", "n", "b > 104857600",
         {"type": "workspace_type", "recoverable": _bytes_text("b"), "count": "n"},
         subject="concat('workspace_type:', workspace_type)"),
    _rec("ctx", "archive", "archive", _priority("archive_bytes", True), 0.88, "'low'",
         "archive_bytes", "archive_count", "archive_bytes > 1048576",
         {"count": "archive_count", "bytes": _bytes_text("archive_bytes")}),
    _rec("ctx", "stale", "stale_cleanup", _priority("stale_bytes", False), 0.72, "'medium'",
         "stale_bytes", "stale_count", "stale_bytes > 5242880",
         {"count": "stale_count", "bytes": _bytes_text("stale_bytes")}),
]) + ")"
# No file of the inventory exceeds the limit of the large-file rule by itself.
LARGE = INV + """,
big AS (SELECT path, size_bytes * 2000 AS size_bytes FROM inv WHERE size_bytes * 2000 > 1073741824),
shown AS (SELECT * FROM big ORDER BY size_bytes DESC, path LIMIT 20),
big_sum AS (SELECT count(*) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS b,
 (SELECT string_agg(path, ',' ORDER BY size_bytes DESC, path) FROM shown) AS paths FROM big)"""

PLAN = SCORED + "," + GROUPS + "," + SPACES.removeprefix(INV + ",") + "," + SECOND + """,
plan AS (
 SELECT 'act-duplicates' AS action_id, 'trash' AS action_type, path, size_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY file_id) AS r FROM members)
  WHERE r > 1
 UNION ALL SELECT 'act-archive', 'archive', path, size_bytes FROM scored
  WHERE is_stale = 1 AND tier = 'archive_candidate' AND category = 'code'
 UNION ALL SELECT 'act-caches', 'compress', path, size_bytes FROM artifacts WHERE is_safe = 1),
checked AS (SELECT p.action_id, p.path, CASE WHEN r.path IS NULL THEN 'missing' ELSE 'ready' END
 AS status, coalesce(r.size_bytes, 0) AS size_bytes FROM plan p LEFT JOIN raw2 r ON r.path = p.path)"""

ACTIONS = """
acts AS (SELECT CAST(user_id AS VARCHAR) AS action_id, event_id, CASE event_type
 WHEN 'view' THEN 'proposed' WHEN 'click' THEN 'dry_run_complete' WHEN 'signup' THEN 'approved'
 WHEN 'purchase' THEN 'executing' ELSE 'completed' END AS status, ts FROM events),
changes AS (SELECT action_id, event_id, lag(status) OVER (PARTITION BY action_id
 ORDER BY ts, event_id) AS from_status, status AS to_status FROM acts),
judged AS (SELECT *, CASE WHEN (from_status IS NULL AND to_status = 'proposed')
 OR concat(from_status, '>', to_status) IN """ + _in(
    [f"{a}>{b}" for a, b in V.ALLOWED_TRANSITIONS]
) + """ THEN 1 ELSE 0 END AS is_allowed FROM changes)"""
RESULTS = """
results AS (SELECT CAST(user_id % 40 AS VARCHAR) AS action_id,
 CAST(round(value * 100) AS BIGINT) AS size_bytes,
 event_type <> 'error' AND user_id % 40 <> 7 AS succeeded FROM events)"""
TASKS = """
tasks AS (SELECT CAST(user_id AS VARCHAR) AS task_id, event_id, CASE event_type
 WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'progress' END AS event_type,
 ts, value FROM events)"""
_WINDOWS = f"""WITH {TASKS} SELECT
 strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, task_id,
 count(*) AS event_count,
 round(sum(CAST(round(value * 100) AS BIGINT)) / 100e0 / count(*), 1) AS files_per_second,
 max(event_id) AS last_event_id FROM tasks GROUP BY date_trunc('hour', ts), task_id"""

SCANS = """
scans AS (SELECT concat('scan-', o_orderkey) AS scan_id, concat('/vol', o_custkey % 20)
 AS root_path, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running'
 ELSE 'failed' END AS status, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN
 o_orderdate + to_seconds(CAST(o_custkey % 3600 + 1 AS INTEGER)) END AS completed_at,
 CAST(round(o_totalprice * 100) AS BIGINT) AS total_size_bytes,
 CAST(o_custkey % 3 AS BIGINT) AS error_count, o_orderdate AS created_at FROM orders)"""

_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {n}"


def _ts(column: str, name: str | None = None) -> str:
    return _TS.format(c=column, n=name or column)


def _day(column: str = "snapshot_date") -> str:
    return f"strftime({column}, '%Y-%m-%d') AS {column}"


_NAMES = [p for p, kind in CHECK_RULES if kind == "name"]
_RULED_FILE = f"""filename IN {_in(_NAMES)} OR coalesce(extension = '.log', false)
 OR contains(path, '/vol3/u1') OR contains(path, 'proj9/dist')
 OR regexp_matches(path, '/proj1[0-9]$')
 OR regexp_matches(path, '/f1[0-9]*-[0-9-]*\\.pdf$')"""
_RULED_TREE = f"""list_has_any(string_split(directory, '/'), [{_in(_NAMES)[1:-1]}])
 OR directory = '/vol3/u1' OR directory LIKE '/vol3/u1/%'
 OR contains('/' || directory || '/', '/proj9/dist/')
 OR regexp_matches(directory || '/', '/proj1[0-9]/')
 OR regexp_matches(directory || '/', '/f1[0-9]*-[0-9-]*\\.pdf/')"""
_PATTERNS = r"""
patterns AS (SELECT CASE s_nationkey % 3
 WHEN 0 THEN concat('/u', s_suppkey % 50, '/proj[0-9]+/(src|docs)/f[0-9]+-[0-9]+-', s_suppkey, '-')
 WHEN 1 THEN concat('/vol', s_suppkey % 4, '/u[0-9]/proj', s_suppkey % 97, '/(build|dist)')
 ELSE concat('-', s_suppkey, '-[1-3]\.(mp4|zip)$|/proj', s_suppkey % 97, '/\.cache/hugging') END AS regex
 FROM supplier UNION ALL SELECT '[1-3]-[0-9]\.p[a-y]$'),
hit_files AS (SELECT DISTINCT path FROM inv JOIN patterns ON regexp_matches(path, regex)),
above AS (SELECT DISTINCT directory, """ + _ANCESTORS + r""" AS folder FROM (SELECT DISTINCT directory FROM inv)),
hit_folders AS (SELECT DISTINCT directory FROM above JOIN patterns ON regexp_matches(folder, regex))"""
_NAMED = """
named AS (SELECT p_partkey AS project_id, concat(replace(p_brand, '#', '-b'),
 CASE p_size % 8 WHEN 0 THEN '' WHEN 1 THEN '-copy' WHEN 2 THEN '-final-v2' WHEN 3 THEN ' (2)'
 WHEN 4 THEN '_backup 3' WHEN 5 THEN '-2' WHEN 6 THEN '-old' ELSE ' Ver12' END) AS name FROM part),
keyed AS (SELECT *, CASE WHEN length(name) < 2 THEN '' ELSE trim(regexp_replace(regexp_replace(
 regexp_replace(trim(lower(name)),
 '[-_\\s]*(copy|backup|bak|old|archive|final|v\\d+|ver\\d+)[-_\\s]*\\d*$', ''),
 '[-_\\s]+\\d+$', ''), '\\s*\\(\\d+\\)$', ''), '-_ ') END AS name_key FROM named)"""
_ALL_SERIES = "(SELECT CAST(c_custkey AS VARCHAR) AS series FROM customer)"
_SNAP = FOLDERS + f""",
cat AS (SELECT category, CAST(sum(size_bytes) AS BIGINT) AS b FROM inv GROUP BY 1),
ext AS (SELECT extension, CAST(sum(size_bytes) AS BIGINT) AS b, count(*) AS n FROM inv
 WHERE extension IS NOT NULL GROUP BY 1 ORDER BY b DESC, extension LIMIT 20)"""
_REC_COLUMNS = (
    "recommendation_id, scan_id, category, priority, title, description, explanation, "
    "confidence, risk_level, recoverable_bytes, affected_count, affected_paths, status"
)
_OVERVIEW = SCORED + "," + GROUPS + "," + SPACES.removeprefix(INV + ",") + f""",
dirs AS (SELECT DISTINCT {_ANCESTORS} AS path FROM inv),
over_row AS (SELECT 'scan-1' AS scan_id, CAST({CAPACITY} AS BIGINT) AS total_storage,
 used_storage, greatest({CAPACITY} - used_storage, 0) AS free_storage, file_count, dir_count,
 duplicate_waste, stale_files_size, workspace_recoverable,
 duplicate_waste + stale_files_size + workspace_recoverable AS recovery_opportunities,
 '1998-06-01T00:00:00.000000Z' AS last_scan_at FROM
 (SELECT CAST(sum(size_bytes) AS BIGINT) AS used_storage, count(*) AS file_count FROM inv),
 (SELECT count(*) AS dir_count FROM dirs),
 (SELECT CAST(coalesce(sum(wasted_bytes), 0) AS BIGINT) AS duplicate_waste FROM groups),
 (SELECT CAST(coalesce(sum(CASE WHEN is_stale = 1 THEN size_bytes END), 0) AS BIGINT)
  AS stale_files_size FROM scored),
 (SELECT CAST(coalesce(sum(recoverable_bytes), 0) AS BIGINT) AS workspace_recoverable FROM found))"""


def oracle_sql() -> dict[str, str]:
    """One statement per query that SQL can express."""
    q: dict[str, str] = {}
    size_sum = "CAST(sum(size_bytes) AS BIGINT)"

    q["inventory_table"] = f"""WITH {INV} SELECT scan_id, file_id, path, size_bytes,
 {_ts('modified_at')}, {_ts('accessed_at')} FROM inv"""
    q["path_normalize"] = """SELECT doc_id, sha256(nfc_normalize(replace(
 concat(source, '\\', lang, '\\', text), '\\', '/'))) AS normalized_sha256 FROM documents"""
    both = "SELECT file_id, path, directory, filename, extension, category FROM"
    q["path_parts"] = f"""WITH {INV}, {PAGES} SELECT file_id, path, directory, filename, extension
 FROM ({both} inv UNION ALL {both} page_inv)"""
    q["category_of"] = f"""WITH {INV}, {PAGES} SELECT file_id, extension, category
 FROM ({both} inv UNION ALL {both} page_inv)"""
    q["file_times"] = f"""WITH {RAW} SELECT file_id, CASE WHEN flag <> 'R' THEN
 strftime(modified_at, '%Y-%m-%dT%H:%M:%S.%fZ') END AS modified_text FROM raw"""
    q["mode_octal"] = f"""WITH {RAW} SELECT file_id, right(format('{{:o}}', mode), 3)
 AS permissions, coalesce(owner, CAST(uid AS VARCHAR)) AS owner FROM raw"""
    q["exclude_files"] = f"WITH {INV} SELECT file_id, path FROM inv WHERE NOT ({_RULED_FILE})"
    q["exclude_subtrees"] = f"WITH {INV} SELECT file_id, path FROM inv WHERE NOT ({_RULED_TREE})"
    for name, hit, key in (("exclude_files_patterns", "hit_files", "path"),
                           ("exclude_subtrees_patterns", "hit_folders", "directory")):
        q[name] = f"""WITH {INV}, {_PATTERNS} SELECT file_id, path FROM inv
 WHERE {key} NOT IN (SELECT {key} FROM {hit})"""
    fixed = " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, '{t}' AS rule_type"
        for p, t in [*V.PLATFORM_RULES["linux"], ("tmp", "name"), ("scratch", "name")]
    )
    q["rule_sources"] = f"""SELECT DISTINCT pattern, rule_type FROM ({fixed} UNION ALL
 SELECT s_name, CASE WHEN s_nationkey < 5 THEN 'extension' ELSE 'name' END FROM supplier
 WHERE s_acctbal > 0)"""
    q["folder_table"] = f"WITH {FOLDERS} SELECT scan_id, path, name, parent_path, depth FROM folders"
    q["folder_rollup"] = f"WITH {FOLDERS} SELECT * FROM folders"
    once = ", once AS (SELECT scan_id, path, max(size_bytes) AS size_bytes FROM raw2 GROUP BY 1, 2),"
    second = RAW + "," + SECOND + once + _parts("once", "inv") + FOLDERS.removeprefix(INV)
    q["folder_rollup_delta"] = f"""WITH {second} SELECT path, name, parent_path, depth, total_size_bytes,
 file_count, dir_count FROM folders"""
    q["folder_direct_sizes"] = f"""WITH {PAGES} SELECT scan_id, directory,
 {size_sum} AS total_size_bytes, count(*) AS file_count FROM page_inv GROUP BY 1, 2"""
    q["depth_limit"] = f"""WITH {INV} SELECT file_id, path FROM inv
 WHERE len(string_split(directory, '/')) - 1 <= 4"""
    q["scan_totals"] = f"""WITH {FOLDERS}, {SCANS} SELECT s.scan_id,
 coalesce(i.total_files, 0) AS total_files, coalesce(d.total_dirs, 0) AS total_dirs,
 coalesce(i.total_size_bytes, 0) AS total_size_bytes,
 CASE WHEN epoch_us(completed_at) > epoch_us(started_at) THEN
 round(coalesce(total_files, 0) / ((epoch_us(completed_at) - epoch_us(started_at)) / 1000000e0), 1)
 ELSE 0e0 END AS files_per_second, CASE WHEN status <> 'completed' THEN status
 WHEN error_count > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status
 FROM scans s LEFT JOIN (SELECT scan_id, count(*) AS total_files, {size_sum} AS total_size_bytes
 FROM inv GROUP BY 1) i ON i.scan_id = s.scan_id
 LEFT JOIN (SELECT scan_id, count(*) AS total_dirs FROM folders GROUP BY 1) d
 ON d.scan_id = s.scan_id"""
    q["scan_registry"] = f"""WITH {SCANS} SELECT scan_id, root_path, status, {_ts('created_at')},
 total_size_bytes FROM (SELECT * FROM scans WHERE status = 'completed'
 ORDER BY created_at DESC, scan_id LIMIT 50 OFFSET 50)"""
    q["scan_latest_completed"] = f"""WITH {SCANS} SELECT root_path, scan_id, {_ts('completed_at')},
 total_size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY root_path
 ORDER BY completed_at DESC, scan_id DESC) AS r FROM scans WHERE status = 'completed') WHERE r = 1"""
    q["inventory_sink"] = f"""WITH {INV} SELECT scan_id, category, count(*) AS file_count,
 {size_sum} AS total_bytes FROM inv GROUP BY 1, 2"""
    q["inventory_arrivals"] = f"""WITH {INV}, arrived AS (
 SELECT scan_id, path, size_bytes, category, -1 AS batch FROM inv
 UNION ALL SELECT scan_id, path, size_bytes + 1, category, 0 FROM inv WHERE category = 'code'
 UNION ALL SELECT scan_id, path || '.new', size_bytes, category, 1 FROM inv WHERE category = 'image'),
last AS (SELECT *, row_number() OVER (PARTITION BY scan_id, path ORDER BY batch DESC, size_bytes DESC,
 category DESC) AS r FROM arrived)
 SELECT category, batch, count(*) AS file_count, {size_sum} AS total_bytes FROM last WHERE r = 1
 GROUP BY 1, 2"""
    delta = INV + "," + SECOND + """,
delta AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new'
 WHEN b.path IS NULL THEN 'gone' WHEN a.modified_at = b.modified_at
 AND a.size_bytes = b.size_bytes THEN 'unchanged' ELSE 'changed' END AS change,
 a.size_bytes AS old_size_bytes, b.size_bytes AS size_bytes
 FROM raw a FULL JOIN raw2 b ON a.path = b.path)"""
    q["inventory_delta"] = f"WITH {delta} SELECT * FROM delta"
    q["inventory_delta_summary"] = f"""WITH {delta} SELECT change, count(*) AS file_count,
 CAST(sum(coalesce(size_bytes, 0) - coalesce(old_size_bytes, 0)) AS BIGINT) AS bytes_difference
 FROM delta GROUP BY 1"""

    q["total_stats"] = f"""WITH {INV} SELECT count(*) AS file_count,
 {size_sum} AS total_bytes FROM inv"""
    q["category_breakdown"] = f"WITH {INV} SELECT category, {size_sum} AS total_bytes FROM inv GROUP BY 1"
    q["extension_breakdown"] = f"""WITH {INV} SELECT extension, {size_sum} AS total_bytes,
 count(*) AS file_count FROM inv WHERE extension IS NOT NULL GROUP BY 1
 ORDER BY 2 DESC, 1 LIMIT 20"""
    q["largest_files"] = f"""WITH {INV} SELECT file_id, path, filename, extension, size_bytes,
 category, {_ts('modified_at')} FROM (SELECT * FROM inv ORDER BY size_bytes DESC, path, file_id
 LIMIT 100)"""
    q["largest_folders"] = f"""WITH {FOLDERS} SELECT path, name, total_size_bytes, file_count, depth
 FROM folders ORDER BY total_size_bytes DESC, path LIMIT 50"""
    q["folder_count"] = f"WITH {FOLDERS} SELECT count(*) AS dir_count FROM folders"
    top = "SELECT string_agg(concat(path, ':', s), ',' ORDER BY s DESC, path)"
    q["snapshot"] = f"""WITH {_SNAP} SELECT 'scan-1' AS scan_id, '1998-06-01' AS snapshot_date,
 CAST({CAPACITY} AS BIGINT) AS total_size_bytes,
 CAST({CAPACITY - CAPACITY // 4} AS BIGINT) AS used_size_bytes,
 (SELECT count(*) FROM inv) AS file_count, (SELECT count(*) FROM folders) AS dir_count,
 (SELECT string_agg(concat(category, ':', b), ',' ORDER BY category) FROM cat) AS categories,
 (SELECT string_agg(concat(extension, ':', b, ':', n), ',' ORDER BY b DESC, extension) FROM ext)
 AS extensions,
 ({top} FROM (SELECT path, size_bytes AS s FROM inv ORDER BY s DESC, path LIMIT 20))
 AS largest_files,
 ({top} FROM (SELECT path, total_size_bytes AS s FROM folders ORDER BY s DESC, path LIMIT 20))
 AS largest_folders"""
    q["snapshot_upsert"] = f"""SELECT 'volume-1' AS volume_id, {_day()}, used_size_bytes, event_id,
 {_ts('created_at')} FROM (SELECT event_id, ts AS created_at, CAST(ts AS DATE) AS snapshot_date,
 CAST(round(value * 100) AS BIGINT) AS used_size_bytes, row_number() OVER
 (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC) AS r FROM events) WHERE r = 1"""
    q["overview"] = f"WITH {_OVERVIEW} SELECT * FROM over_row"
    q["storage_health"] = f"""WITH {_OVERVIEW}, pct AS (SELECT *, CAST(floor(free_storage
 / total_storage * 100 + 0.5e0) AS BIGINT) AS free_percent FROM over_row)
 SELECT scan_id, free_percent, 100 - free_percent AS used_percent, free_percent < 10 AS is_low,
 free_percent < 5 AS is_critical, CASE WHEN free_percent < 5 THEN 'almost_full'
 WHEN free_percent < 10 THEN 'low_space' WHEN recovery_opportunities > 0 THEN 'recoverable'
 ELSE 'scanned' END AS headline FROM pct"""
    q["categories_report"] = f"""WITH {INV} SELECT 'scan-1' AS scan_id,
 '1998-06-01' AS snapshot_date, category, {size_sum} AS total_bytes FROM inv GROUP BY category"""
    q["extensions_report"] = f"""WITH {INV} SELECT 'scan-1' AS scan_id,
 '1998-06-01' AS snapshot_date, extension, {size_sum} AS total_bytes, count(*) AS file_count
 FROM inv WHERE extension IS NOT NULL GROUP BY extension ORDER BY 4 DESC, 3 LIMIT 20"""
    q["largest_files_report"] = f"""WITH {INV} SELECT file_id, path, size_bytes,
 (SELECT count(*) FROM inv) AS total_count FROM inv ORDER BY size_bytes DESC, path, file_id
 LIMIT 20"""
    q["largest_folders_report"] = f"""WITH {FOLDERS} SELECT path, name, total_size_bytes,
 file_count, depth, (SELECT count(*) FROM folders) AS total_count FROM folders
 ORDER BY total_size_bytes DESC, path LIMIT 20"""
    q["latest_snapshot"] = f"""WITH {SCANNED} SELECT volume_id, {_day()}, total_size_bytes,
 used_size_bytes, file_count, dir_count, scan_id FROM (SELECT *, row_number() OVER
 (PARTITION BY volume_id ORDER BY snapshot_date DESC) AS r FROM per_day) WHERE r = 1"""
    q["snapshot_history"] = f"""WITH {DAILY} SELECT volume_id, {_day()}, total_size_bytes,
 used_size_bytes, file_count, dir_count FROM (SELECT * FROM snaps WHERE snapshot_date BETWEEN
 DATE '2024-01-05' AND DATE '2024-01-20')"""
    q["growth_series"] = f"""WITH {DAILY} SELECT volume_id, {_day()}, total_size_bytes,
 used_size_bytes, file_count FROM (SELECT *, row_number() OVER
 (PARTITION BY volume_id ORDER BY snapshot_date DESC) AS r FROM snaps) WHERE r <= 14"""
    q["growth_rate"] = f"""WITH {DAILY}, ends AS (SELECT volume_id,
 min_by(used_size_bytes, snapshot_date) AS first_bytes,
 max_by(used_size_bytes, snapshot_date) AS last_bytes,
 CAST(date_diff('day', min(snapshot_date), max(snapshot_date)) AS INTEGER) AS days
 FROM snaps GROUP BY 1) SELECT *, CASE WHEN days > 0 THEN
 round((last_bytes - first_bytes) / CAST(days AS DOUBLE), 2) ELSE 0e0 END AS daily_growth_bytes
 FROM ends"""
    bases = " ".join(
        f"LEFT JOIN LATERAL (SELECT {n}.used_size_bytes AS {n}_bytes, {n}.snapshot_date AS {n}_date FROM per_day {n} "
        f"WHERE {n}.volume_id = p.volume_id AND date_diff('day', {n}.snapshot_date, p.snapshot_date) "
        f"BETWEEN {days} AND {2 * days - 1} ORDER BY {n}.snapshot_date DESC LIMIT 1) AS {n}_base ON true"
        for n, days in (("daily", 1), ("weekly", 7), ("monthly", 30)))
    changes = ", ".join(
        f"p.used_size_bytes - {n}_bytes AS {n}_growth_bytes, strftime({n}_date, '%Y-%m-%d') AS {n}_base_date"
        for n in ("daily", "weekly", "monthly"))
    q["weekly_monthly_usage"] = f"""WITH {SCANNED} SELECT p.volume_id, strftime(p.snapshot_date, '%Y-%m-%d') AS snapshot_date,
 p.used_size_bytes, {changes} FROM per_day p {bases}"""
    q["weekly_usage"] = f"""WITH {DAILY}, weeks AS (SELECT volume_id,
 date_trunc('week', snapshot_date) AS period_start,
 max_by(used_size_bytes, snapshot_date) AS end_bytes,
 max_by(used_size_bytes, snapshot_date) - min_by(used_size_bytes, snapshot_date) AS growth_bytes
 FROM snaps GROUP BY 1, 2) SELECT volume_id, {_day('period_start')}, end_bytes, growth_bytes
 FROM weeks"""
    code = "category = 'code' AND size_bytes >= 1000000"
    q["paged_list"] = f"""WITH {INV} SELECT file_id, path, size_bytes FROM inv WHERE {code}
 ORDER BY size_bytes DESC, path, file_id LIMIT 40 OFFSET 80"""
    q["paged_list_deep"] = f"""WITH {INV} SELECT file_id, path, size_bytes FROM inv
 ORDER BY size_bytes DESC, path, file_id LIMIT 50 OFFSET 5800"""
    q["paged_list_after"] = f"""WITH {INV} SELECT file_id, path, size_bytes FROM inv
 WHERE size_bytes < 3000000 OR (size_bytes = 3000000 AND (path > '/vol2' OR (path = '/vol2' AND file_id > '')))
 ORDER BY size_bytes DESC, path, file_id LIMIT 40"""
    q["paged_list_totals"] = f"""WITH {INV} SELECT count(*) AS total,
 CAST(ceil(count(*) / 40e0) AS BIGINT) AS pages FROM inv WHERE {code}"""
    q["share_of_total"] = f"""WITH {INV}, g AS (SELECT category, {size_sum} AS total_bytes FROM inv
 GROUP BY 1), s AS (SELECT *, round(total_bytes / sum(total_bytes) OVER () * 100, 1) AS share_pct
 FROM g) SELECT *, concat(CAST(CAST(share_pct AS DECIMAL(20, 1)) AS VARCHAR), '%') AS share_text
 FROM s"""

    q["dup_size_groups"] = f"""WITH {SECOND_CONTENT} SELECT scan_id, size_bytes, count(*) AS file_count
 FROM contents WHERE size_bytes >= 1024 GROUP BY 1, 2 HAVING count(*) > 1"""
    q["dup_size_candidates"] = f"""WITH {SECOND_CONTENT} SELECT scan_id, file_id, size_bytes FROM (SELECT *,
 count(*) OVER (PARTITION BY scan_id, size_bytes) AS n FROM contents WHERE size_bytes >= 1024) WHERE n > 1"""
    ends = "left(hex(body), 8192) || right(hex(body), 8192)"
    q["dup_partial_hash"] = f"""WITH {SECOND_CONTENT}, e AS (SELECT scan_id, file_id, size_bytes,
 CASE WHEN size_bytes <= 8192 THEN hex(body) ELSE {ends} END AS ends FROM contents
 WHERE size_bytes >= 1024) SELECT scan_id, file_id, size_bytes FROM (SELECT *, count(*) OVER
 (PARTITION BY scan_id, size_bytes, ends) AS n FROM e) WHERE n > 1"""
    q["dup_full_hash"] = f"WITH {CONTENT} SELECT file_id, path, size_bytes, sha256 FROM content"
    q["dup_groups"] = f"WITH {GROUPS} SELECT * FROM groups"
    q["dup_members"] = f"""WITH {GROUPS} SELECT group_id, file_id, path, false AS is_keeper
 FROM members"""
    q["dup_flag"] = f"""WITH {GROUPS} SELECT file_id, path, CASE WHEN count(*) OVER
 (PARTITION BY sha256) > 1 THEN 1 ELSE 0 END AS is_duplicate FROM hashed"""
    summary = """SELECT count(*) AS total_groups, CAST(sum(member_count) AS BIGINT)
 AS total_duplicate_files, CAST(sum(wasted_bytes) AS BIGINT) AS total_wasted_bytes FROM groups"""
    q["dup_summary"] = q["dup_replace"] = f"WITH {GROUPS} {summary}"
    q["dup_top_extensions"] = f"""WITH {GROUPS} SELECT extension, count(*) AS file_count
 FROM members GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
    q["dup_group_list"] = f"""WITH {GROUPS} SELECT group_id, file_size_bytes, member_count,
 wasted_bytes, status FROM groups WHERE wasted_bytes >= 2000
 ORDER BY wasted_bytes DESC, group_id LIMIT 20"""
    q["dup_group_list_totals"] = f"""WITH {GROUPS} SELECT count(*) AS total,
 CAST(ceil(count(*) / 20e0) AS BIGINT) AS pages FROM groups WHERE wasted_bytes >= 2000"""
    q["dup_group_detail"] = f"""WITH {GROUPS} SELECT group_id, file_size_bytes, member_count,
 wasted_bytes, status, file_id, path, 0 AS is_keeper FROM members"""
    q["dup_resolve"] = f"WITH {DECIDED} SELECT group_id, file_id, status, is_keeper FROM resolved"
    q["dup_resolve_report"] = f"""WITH {DECIDED} SELECT group_id, member_count,
 member_count - 1 AS files_removable, wasted_bytes AS bytes_recovered, file_id AS keeper_file_id
 FROM resolved WHERE is_keeper = 1"""
    q["dup_auto_keeper"] = f"""WITH {GROUPS} SELECT group_id, file_id AS keep_file_id FROM (
 SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY modified_at DESC, file_id DESC) AS r
 FROM members) WHERE r = 1"""
    q["dup_removable"] = f"WITH {REMOVABLE} SELECT * FROM removable"
    q["dup_removable_strict"] = f"""WITH {REMOVABLE} SELECT group_id, file_id, path, size_bytes
 FROM numbered WHERE is_keeper = 0 AND r > 1"""
    q["dup_removable_bytes"] = f"""WITH {REMOVABLE} SELECT count(*) AS file_count,
 CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM removable"""
    q["dup_verify_bytes"] = f"""WITH {GROUPS}, firsts AS (SELECT group_id, min(file_id) AS f
 FROM members GROUP BY 1) SELECT m.group_id, f.f AS first_file_id, m.file_id,
 CASE WHEN a.body = b.body THEN 1 ELSE 0 END AS identical FROM members m
 JOIN firsts f ON f.group_id = m.group_id AND f.f <> m.file_id
 JOIN content a ON a.file_id = m.file_id JOIN content b ON b.file_id = f.f"""
    q["content_hash"] = f"WITH {CONTENT} SELECT file_id, sha256 FROM content"
    q["dup_incremental"] = f"""WITH {SECOND_CONTENT} SELECT scan_id, sha256 AS group_id,
 min(size_bytes) AS file_size_bytes, count(*) AS member_count,
 min(size_bytes) * (count(*) - 1) AS wasted_bytes FROM content2 WHERE size_bytes >= 1024
 GROUP BY 1, 2 HAVING count(*) > 1"""
    q["hardlink_collapse"] = f"""WITH {RAW} SELECT path, file_id, size_bytes, device, inode,
 link_count FROM (SELECT *, row_number() OVER (PARTITION BY device, inode ORDER BY path, file_id,
 size_bytes) AS r, count(*) OVER (PARTITION BY device, inode) AS link_count FROM raw) WHERE r = 1"""

    q["days_since"] = f"""WITH {RAW} SELECT file_id, CASE WHEN flag = 'R' OR state = 'O'
 THEN 9999e0 ELSE round({_days('modified_at')}, 4) END AS days FROM raw"""
    for name in ("stale_score", "is_stale", "risk_level"):
        q[name] = f"WITH {SCORED} SELECT file_id, {name} FROM scored"
    q["is_dev_artifact"] = f"WITH {SCORED} SELECT file_id, is_artifact FROM scored"
    q["freshness_by_age"] = f"""WITH {SCORED} SELECT CASE WHEN days_access <= 60 THEN 'active'
 WHEN days_access <= 365 THEN 'aging' WHEN days_access <= 1000 THEN 'stale'
 ELSE 'archive_candidate' END AS tier, count(*) AS file_count, {size_sum} AS total_bytes
 FROM scored GROUP BY 1"""
    q["stale_scan"] = f"""WITH {SCORED} SELECT file_id, path, stale_score, tier, risk_level,
 is_stale FROM scored"""
    tiers = " UNION ALL ".join(f"SELECT '{t}' AS tier" for t in V.TIER_NAMES)
    late = "tier IN ('stale', 'archive_candidate')"
    q["stale_summary"] = f"""WITH {SCORED}, names AS ({tiers}) SELECT n.tier,
 count(s.file_id) AS file_count, CAST(coalesce(sum(s.size_bytes), 0) AS BIGINT) AS total_bytes,
 (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM scored WHERE {late})
 AS recoverable_bytes, (SELECT count(*) FROM scored WHERE {late}) AS total_stale_files
 FROM names n LEFT JOIN scored s ON s.tier = n.tier GROUP BY n.tier"""
    q["stale_risk_breakdown"] = f"""WITH {SCORED} SELECT risk_level, count(*) AS file_count,
 {size_sum} AS total_bytes FROM scored WHERE is_stale = 1 GROUP BY 1"""
    q["stale_files"] = f"""WITH {SCORED} SELECT file_id, path, stale_score, size_bytes FROM scored
 WHERE is_stale = 1 AND tier = 'archive_candidate' AND risk_level = 'low' AND category = 'code'
 AND size_bytes >= 100000 ORDER BY stale_score DESC, size_bytes DESC, path, file_id
 LIMIT 100 OFFSET 100"""
    likes = " UNION ALL ".join(
        f"SELECT '{kind}' AS artifact_type, size_bytes FROM inv WHERE path ILIKE '{pattern}'"
        for kind, pattern in V.ARTIFACT_LIKE_PATTERNS
    )
    q["dev_artifact_summary"] = f"""WITH {INV} SELECT artifact_type, count(*) AS file_count,
 {size_sum} AS total_bytes FROM ({likes}) GROUP BY 1"""
    q["dev_artifact_totals"] = f"""WITH {INV} SELECT {size_sum} AS total_recoverable_bytes,
 count(*) AS total_artifact_files FROM ({likes})"""
    q["orphaned_content"] = f"""WITH {RAW}, {SCANS}, o AS (SELECT file_id,
 concat('scan-', string_split(file_id, '-')[1]) AS scan_id FROM raw) SELECT file_id, scan_id
 FROM o WHERE scan_id NOT IN (SELECT scan_id FROM scans WHERE status = 'completed')"""

    q["artifact_match"] = f"""WITH {SPACES} SELECT file_id, root, workspace_type, artifact_type,
 risk_level, is_safe FROM artifacts"""
    q["workspace_root"] = f"WITH {SPACES} SELECT file_id, path, root FROM artifacts"
    q["workspace_type"] = f"WITH {SPACES} SELECT path, workspace_type FROM found"
    q["workspace_risk"] = f"WITH {SPACES} SELECT path, workspace_type, risk_level FROM found"
    q["ml_model_files"] = f"""WITH {SPACES} SELECT file_id, root, size_bytes FROM artifacts
 WHERE is_model = 1"""
    q["workspaces"] = f"""WITH {SPACES} SELECT path, name, workspace_type,
 total_size_bytes, recoverable_bytes, safe_recoverable_bytes, file_count, risk_level,
 days_inactive, is_active, {_ts('last_modified_at')} FROM found"""
    per_type = """SELECT root AS path, artifact_type, CAST(sum(size_bytes) AS BIGINT)
 AS total_bytes, count(*) AS file_count FROM artifacts GROUP BY 1, 2"""
    q["workspace_artifacts"] = f"WITH {SPACES} {per_type}"
    q["workspace_artifact_lists"] = f"""WITH {SPACES} SELECT path, string_agg(concat(artifact_type,
 ':', total_bytes, ':', file_count), ',' ORDER BY total_bytes DESC, artifact_type) AS artifacts
 FROM ({per_type}) GROUP BY 1"""
    q["project_name_key"] = f"WITH {_NAMED} SELECT project_id, name, name_key FROM keyed"
    q["lookalike_projects"] = f"""WITH {_NAMED} SELECT name_key, concat('/projects/', project_id,
 '/', name) AS path, group_size FROM (SELECT *, count(*) OVER (PARTITION BY name_key)
 AS group_size FROM keyed WHERE name_key <> '') WHERE group_size > 1"""
    q["abandoned_flag"] = f"WITH {SPACES} SELECT path, days_inactive, is_active FROM found"
    sums = ", ".join(
        f"CAST(sum({c}) AS BIGINT) AS {n}"
        for c, n in (("total_size_bytes", "total_bytes"), ("recoverable_bytes", "recoverable_bytes"),
                     ("safe_recoverable_bytes", "safe_recoverable_bytes"))
    )
    q["workspace_summary"] = f"""WITH {SPACES} SELECT workspace_type, count(*) AS workspace_count,
 {sums}, count(CASE WHEN is_active = 0 THEN 1 END) AS inactive_count FROM found
 GROUP BY ROLLUP (workspace_type)"""
    q["workspace_list"] = f"""WITH {SPACES} SELECT path, workspace_type, recoverable_bytes,
 days_inactive FROM found WHERE workspace_type = 'node' AND is_active = 0
 AND recoverable_bytes >= 100000 ORDER BY recoverable_bytes DESC, path LIMIT 100"""
    q["abandoned_projects"] = f"""WITH {SPACES} SELECT path, recoverable_bytes, days_inactive,
 count(*) OVER () AS abandoned_count, CAST(sum(recoverable_bytes) OVER () AS BIGINT)
 AS abandoned_bytes FROM found WHERE is_active = 0"""
    q["workspace_job"] = f"""WITH {FOLDERS}, {SPACES.removeprefix(INV + ',')} SELECT s.path,
 s.workspace_type, s.recoverable_bytes, s.days_inactive, f.total_size_bytes
 AS project_total_bytes FROM found s LEFT JOIN folders f ON f.path = s.path"""
    q["inactivity_buckets"] = f"""WITH {SPACES} SELECT CASE WHEN days_inactive < 180 THEN
 'under_6_months' WHEN days_inactive < 365 THEN '6_to_12_months' WHEN days_inactive < 730 THEN
 '1_to_2_years' ELSE 'over_2_years' END AS bucket, count(*) AS workspace_count,
 CAST(sum(recoverable_bytes) AS BIGINT) AS recoverable_bytes FROM found GROUP BY 1"""
    q["download_bloat"] = f"""WITH {INV} SELECT file_id, path, size_bytes FROM inv
 WHERE list_contains(string_split(directory, '/'), 'docs')
 AND extension IN {_in(V.DOWNLOAD_EXTENSIONS)} AND floor((epoch_us(TIMESTAMP '{AS_OF}')
 - epoch_us(modified_at)) / 86400000000e0) >= 365"""
    q["model_hoarding"] = f"""WITH {SPACES}, n AS (SELECT *, row_number() OVER (PARTITION BY root
 ORDER BY modified_at DESC, file_id DESC) AS r FROM artifacts WHERE is_model = 1)
 SELECT root AS path, count(*) AS model_count, {size_sum} AS total_bytes,
 max(CASE WHEN r = 1 THEN file_id END) AS newest_file_id,
 CAST(sum(CASE WHEN r > 1 THEN size_bytes ELSE 0 END) AS BIGINT) AS redundant_bytes
 FROM n GROUP BY 1 HAVING count(*) > 1"""
    q["recovery_split"] = f"""WITH {SPACES} SELECT workspace_type,
 CAST(sum(recoverable_bytes) AS BIGINT) AS potential_bytes,
 CAST(sum(safe_recoverable_bytes) AS BIGINT) AS safe_bytes,
 CAST(sum(recoverable_bytes - safe_recoverable_bytes) AS BIGINT) AS high_risk_bytes
 FROM found GROUP BY 1"""

    q["forecast_series"] = f"WITH {POINTS} SELECT series, day_index, bytes FROM points"
    q["growth_deltas"] = f"""WITH {POINTS} SELECT series, day_index, round(delta, 2) AS delta
 FROM deltas WHERE delta IS NOT NULL"""
    q["rolling_growth"] = f"""WITH {POINTS} SELECT series, day_index, round(avg(delta) OVER
 (PARTITION BY series ORDER BY day_index ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0)
 AS rolling_growth_bytes FROM deltas WHERE delta IS NOT NULL"""
    q["forecast_linear"] = _forecast("linear")
    q["forecast_moving_average"] = _forecast("moving")
    q["forecast_exp_smoothing"] = _forecast("smoothing")
    q["forecast_auto"] = q["latest_forecast"] = _forecast("auto")
    trend = _TREND.format(daily="(c_custkey % 7 * 1.5e0)", total="round(c_acctbal)")
    q["trend_class"] = f"SELECT c_custkey, {trend} AS trend FROM customer"
    q["forecast_store"] = f"""WITH {DAILY} SELECT DISTINCT volume_id AS series,
 CAST(2 AS BIGINT) AS stored_runs, '2024-01-31 00:00:00' AS last_created_at FROM snaps"""
    q["forecast_confidence"] = f"""WITH {FIT} SELECT series, round(confidence, 3) AS confidence
 FROM linear"""
    q["exhaustion"] = f"""WITH {FIT} SELECT series, days_until_full, {_EXHAUSTED}
 AS exhaustion_date FROM auto"""
    q["capacity_default"] = f"WITH {FIT} SELECT series, capacity_bytes FROM fit"
    q["exhaustion_report"] = f"""WITH {FIT} SELECT c.series, {_EXHAUSTED} AS exhaustion_date,
 days_until_full, round(coalesce(daily, 0), 0) AS daily_growth_bytes,
 round(coalesce(daily * 7, 0), 0) AS weekly_growth_bytes,
 round(coalesce(confidence, 0), 3) AS confidence, model_type
 FROM {_ALL_SERIES} c LEFT JOIN auto a ON a.series = c.series"""
    trend = _TREND.format(daily="daily", total="current_bytes")
    q["growth_rate_report"] = f"""WITH {FIT} SELECT c.series,
 round(coalesce(daily, 0), 0) AS daily_growth_bytes,
 round(coalesce(daily * 7, 0), 0) AS weekly_growth_bytes,
 round(coalesce(daily * 30, 0), 0) AS monthly_growth_bytes,
 CASE WHEN a.series IS NULL THEN 'stable' ELSE {trend} END AS trend,
 round(coalesce(confidence, 0), 3) AS confidence
 FROM {_ALL_SERIES} c LEFT JOIN auto a ON a.series = c.series"""

    priced = "(CAST(round(o_totalprice * 1000) AS BIGINT) * 500)"
    q["priority_of"] = f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN
 {_priority(priced, True)} ELSE {_priority(priced, False)} END AS priority FROM orders"""
    q["human_bytes"] = f"""WITH s AS (SELECT o_orderkey, o_custkey,
 CAST(round(o_totalprice * 100) AS BIGINT) * o_custkey AS n FROM orders) SELECT o_orderkey,
 {_bytes_text('n')} AS size_text, {_bytes_text('n * 1000', True)} AS large_text,
 {_bytes_text('o_custkey')} AS small_text FROM s"""
    q["context"] = f"""WITH {CONTEXT} SELECT 'scan-1' AS scan_id, duplicate_groups,
 duplicate_files, wasted_bytes, stale_bytes, stale_count, archive_bytes, archive_count,
 workspace_count, workspace_bytes, workspace_safe_bytes, inactive_workspaces, free_storage,
 round(daily_growth_bytes, 0) AS daily_growth_bytes, top_extensions, by_type, largest_files
 FROM ctx"""
    q["recommendations"] = f"WITH {RECS} SELECT * FROM recs"
    for name, category in (
        ("rec_growth_warning", "growth_warning"), ("rec_duplicates", "duplicate_cleanup"),
        ("rec_workspaces", "workspace_cleanup"),
    ):
        q[name] = f"WITH {RECS} SELECT * FROM recs WHERE category = '{category}'"
    q["rec_stale"] = f"""WITH {RECS} SELECT * FROM recs
 WHERE category IN ('archive', 'stale_cleanup')"""
    q["rec_large_files"] = f"WITH {LARGE} " + _rec(
        "big_sum", "large_files", "large_file", _priority("b", False), 0.65, "'medium'", "b", "n",
        "n > 0", {"count": "n", "bytes": _bytes_text("b")}, paths="paths",
    )
    rank = "list_position(['critical', 'high', 'medium', 'low'], priority)"
    q["rec_list"] = f"""WITH {RECS} SELECT recommendation_id, priority, recoverable_bytes FROM recs
 WHERE status = 'pending' AND priority = 'critical'
 ORDER BY {rank}, recoverable_bytes DESC, recommendation_id LIMIT 20"""
    q["rec_detail"] = f"""WITH {RECS} SELECT * FROM recs
 WHERE recommendation_id = 'scan-1/archive/archive'"""
    q["rec_decide"] = f"""WITH {RECS}, d AS (SELECT concat('scan-1/', CASE user_id % 4
 WHEN 0 THEN 'archive/archive' WHEN 1 THEN 'stale_cleanup/stale'
 WHEN 2 THEN 'duplicate_cleanup/duplicates' ELSE 'workspace_cleanup/regenerable' END)
 AS recommendation_id, CASE WHEN event_type = 'error' THEN 'dismissed' ELSE 'accepted' END
 AS status, CASE WHEN event_type = 'error' THEN concat('by user ', user_id) END AS reason,
 event_id FROM events), last AS (SELECT * FROM (SELECT *, row_number() OVER
 (PARTITION BY recommendation_id ORDER BY event_id DESC) AS r FROM d) WHERE r = 1)
 SELECT e.recommendation_id, coalesce(l.status, e.status) AS status, CASE WHEN
 l.status = 'dismissed' THEN l.reason END AS dismissed_reason FROM recs e LEFT JOIN last l
 ON l.recommendation_id = e.recommendation_id"""
    q["rec_replace"] = f"""WITH {RECS} SELECT scan_id, priority, count(*) AS recommendation_count,
 CAST(sum(recoverable_bytes) AS BIGINT) AS recoverable_bytes FROM recs GROUP BY 1, 2"""

    made = RECS.replace("c_free AS (SELECT CAST(sum(size_bytes) AS BIGINT) AS free_storage,\n "
        "sum(size_bytes) / 100e0 AS daily_growth_bytes FROM inv)",
        f"c_free AS (SELECT CAST({CAPACITY // 4} AS BIGINT) AS free_storage, (SELECT "
        "sum((b - a) / CAST(d AS DOUBLE)) FROM (SELECT min_by(used_size_bytes, snapshot_date) "
        "AS a, max_by(used_size_bytes, snapshot_date) AS b, date_diff('day', "
        "min(snapshot_date), max(snapshot_date)) AS d FROM snaps GROUP BY volume_id)) "
        "AS daily_growth_bytes)")
    counted = {
        "scored_files": "inv", "workspaces": "found", "file_hashes": "hashed",
        "duplicate_groups": "groups", "duplicate_members": "members", "recommendations": "recs",
        "forecasts": "(SELECT DISTINCT volume_id FROM snaps)",
        "folders": f"(SELECT DISTINCT {_ANCESTORS} AS path FROM inv)",
        "snapshots": "(SELECT 1)",
    }
    q["analysis_job"] = f"WITH {DAILY}, {made} " + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {source}"
        for name, source in counted.items()
    )

    # Ten days lie between the two scans; no capacity is known, so their files' bytes are in use.
    q["analysis_history"] = f"""WITH {INV}, {SECOND},
 one AS (SELECT {size_sum} AS b FROM inv), two AS (SELECT {size_sum} AS b FROM raw2 WHERE path NOT LIKE '%.bak')
 SELECT 'scan-2' AS scan_id, '1998-06-11' AS forecast_date, 'vol' AS volume_id, 2 AS points,
 one.b AS first_bytes, two.b AS last_bytes, round((two.b - one.b) / 10e0, 1) AS daily_growth_bytes FROM one, two"""

    q["plan_propose"] = f"""WITH {PLAN} SELECT action_id, action_type, count(*) AS target_count,
 {size_sum} AS total_bytes, 'proposed' AS status FROM plan GROUP BY 1, 2"""
    q["plan_dry_run"] = f"""WITH {PLAN} SELECT action_id,
 count(CASE WHEN status = 'ready' THEN 1 END) AS valid_count,
 count(CASE WHEN status = 'missing' THEN 1 END) AS missing_count, {size_sum} AS valid_bytes
 FROM checked GROUP BY 1"""
    q["plan_dry_run_targets"] = f"WITH {PLAN} SELECT * FROM checked"
    q["plan_directory_size"] = f"""WITH {FOLDERS}, {SPACES.removeprefix(INV + ',')} SELECT s.path,
 f.total_size_bytes, f.file_count FROM found s JOIN folders f ON f.path = s.path"""
    q["action_transitions"] = f"WITH {ACTIONS} SELECT * FROM judged"
    q["action_transition_violations"] = f"""WITH {ACTIONS} SELECT action_id, event_id, from_status,
 to_status FROM judged WHERE is_allowed = 0"""
    states = """SELECT action_id, max_by(status, (ts, event_id)) AS status, count(*)
 AS event_count, max(ts) AS updated_at FROM acts GROUP BY 1"""
    q["action_state"] = f"WITH {ACTIONS} SELECT action_id, status, event_count FROM ({states})"
    q["action_outcome"] = f"""WITH {RESULTS}, o AS (SELECT action_id,
 count(CASE WHEN succeeded THEN 1 END) AS files_processed,
 CAST(coalesce(sum(CASE WHEN succeeded THEN size_bytes END), 0) AS BIGINT) AS bytes_recovered,
 count(CASE WHEN NOT succeeded THEN 1 END) AS errors FROM results GROUP BY 1)
 SELECT action_id, CASE WHEN files_processed = 0 THEN 'failed' ELSE 'completed' END AS status,
 files_processed, bytes_recovered, errors, CASE WHEN files_processed > 0 AND errors > 0 THEN
 concat(errors, ' files skipped') END AS message FROM o"""
    q["rollback_outcome"] = f"""WITH {RESULTS} SELECT action_id, 'rolled_back' AS status,
 count(CASE WHEN succeeded THEN 1 END) AS files_restored,
 CAST(coalesce(sum(CASE WHEN succeeded THEN size_bytes END), 0) AS BIGINT) AS bytes_restored,
 count(CASE WHEN NOT succeeded THEN 1 END) AS errors FROM results GROUP BY 1"""
    q["action_list"] = f"""WITH {ACTIONS} SELECT action_id, status, {_ts('updated_at')} FROM (
 SELECT * FROM ({states}) WHERE status = 'approved' ORDER BY updated_at DESC, action_id LIMIT 25)"""
    audit = """
log AS (SELECT concat('audit-', event_id) AS log_id, concat('corr-', user_id % 50)
 AS correlation_id, concat('cleanup_', event_type) AS action, concat('cleanup_', event_type,
 ' cleanup_action ', user_id) AS description, CAST(round(value * 100) AS BIGINT)
 AS bytes_affected, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning'
 ELSE 'info' END AS severity, ts AS created_at FROM events)"""
    q["audit_append"] = f"""WITH {audit} SELECT action, severity, count(*) AS record_count,
 CAST(sum(bytes_affected) AS BIGINT) AS bytes_affected FROM log GROUP BY 1, 2"""
    q["audit_query"] = f"""WITH {audit} SELECT log_id, correlation_id, action, description,
 bytes_affected, severity, {_ts('created_at')} FROM (SELECT * FROM log WHERE severity = 'error'
 AND correlation_id = 'corr-7' ORDER BY created_at DESC, log_id LIMIT 50)"""
    terminal = "CASE WHEN event_type IN ('completed', 'failed') THEN 1 ELSE 0 END AS is_terminal"
    q["task_progress"] = f"""WITH {TASKS} SELECT task_id, event_id, event_type,
 round(value, 1) AS files_per_second, event_count, {terminal} FROM (SELECT *, row_number() OVER
 (PARTITION BY task_id ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY task_id)
 AS event_count FROM tasks) WHERE r = 1"""
    q["task_events_after"] = f"""WITH {TASKS} SELECT task_id, event_id, event_type, {terminal}
 FROM tasks WHERE task_id = '8' AND event_id > 500"""
    q["task_progress_windows"] = q["task_progress_stream"] = _WINDOWS
    # Closed an hour after a terminal event, or a week after any, an hour behind the newest of all.
    q["task_ended_stream"] = f"""WITH {TASKS}, last AS (SELECT *, epoch_us(ts) AS ended_micros,
 count(*) OVER (PARTITION BY task_id) AS event_count, {terminal},
 row_number() OVER (PARTITION BY task_id ORDER BY event_id DESC) AS r,
 max(epoch_us(ts) // 1000) OVER () - 3600000 AS mark FROM tasks)
 SELECT task_id, event_id, event_type, event_count, ended_micros, is_terminal FROM last WHERE r = 1
 AND ended_micros // 1000 + CASE WHEN is_terminal = 1 THEN 3600000 ELSE 604800000 END <= mark"""
    return q
