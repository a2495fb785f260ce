"""The expected result of each query in DuckDB SQL, written against the supplied tables.

The statements are put together from small pieces per column, since a report over a table is one SELECT per column.
"""

from __future__ import annotations

from itertools import combinations

from query_set.views import COLUMNS, view_sql
from tablescope.operators.schema import BOOLEAN_PAIRS, TARGET_KEYWORDS, TIME_KEYWORDS

INTEGERS = ("int", "bigint")
NUMBERS = ("int", "bigint", "double")
EDGE = r"^\s|\s$"
NUMERIC = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"
DATE = r"\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*"
DIRTY = "orders_dirty"


def with_(view: str, body: str, *ctes: str) -> str:
    parts = [p for p in (view_sql(view), *ctes) if p]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def numbers(view: str) -> list[str]:
    return [c for c, t in COLUMNS[view] if t in NUMBERS]


def strings(view: str) -> list[str]:
    return [c for c, t in COLUMNS[view] if t == "string"]


def position(view: str, column: str) -> int:
    return [c for c, _ in COLUMNS[view]].index(column)


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def trim(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def kind(t: str) -> str:
    return "numeric" if t in NUMBERS else "string" if t == "string" else "datetime"


def facts(view: str) -> str:
    """A CTE ``facts`` with one row per column of the view."""
    rows = []
    for i, (c, t) in enumerate(COLUMNS[view]):
        text = t == "string"
        whole = t in INTEGERS
        order = "cnt DESC, CAST(value AS DOUBLE), value" if t in NUMBERS else "cnt DESC, value"
        rows.append(f"""
SELECT '{c}' AS col, {i} AS position, '{t}' AS data_type, '{kind(t)}' AS kind, {str(whole).lower()} AS is_integer,
 (SELECT count(*) FROM {view}) AS n_rows, CAST(count(*) AS BIGINT) AS n_unique,
 CAST(coalesce(sum(cnt), 0) AS BIGINT) AS n_nonnull, min(value) AS value_min, max(value) AS value_max,
 first(value ORDER BY {order}) AS majority, max(cnt) AS majority_cnt,
 last(value ORDER BY {order}) AS minority, min(cnt) AS minority_cnt,
 {"min(CAST(value AS BIGINT))" if whole else "NULL"} AS low, {"max(CAST(value AS BIGINT))" if whole else "NULL"} AS high,
 {"CAST(sum(cnt * length(value)) AS DOUBLE) / sum(cnt)" if text else "NULL"} AS avg_len,
 {"min(length(value))" if text else "NULL"} AS min_len, {"max(length(value))" if text else "NULL"} AS max_len,
 {f"CAST(coalesce(sum(cnt) FILTER (regexp_full_match(value, '{NUMERIC}')), 0) AS DOUBLE) / sum(cnt)" if text else "NULL"}
   AS numeric_rate,
 {f"CAST(coalesce(sum(cnt) FILTER (regexp_full_match(value, '{DATE}') AND try_cast(value AS TIMESTAMP) IS NOT NULL), 0) AS DOUBLE) / sum(cnt)" if text else "1.0" if kind(t) == "datetime" else "NULL"}
   AS datetime_rate
FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM {view} WHERE {c} IS NOT NULL GROUP BY 1)""")
    return f"facts AS ({union(rows)})"


def semantic() -> str:
    pairs = " OR ".join(f"(value_min = '{a}' AND value_max = '{b}')" for a, b in BOOLEAN_PAIRS)
    return f"""CASE WHEN kind = 'string' AND n_unique = 2 AND ({pairs}) THEN 'boolean'
 WHEN kind = 'numeric' AND n_unique <= 2 THEN 'boolean'
 WHEN kind = 'numeric' AND n_unique <= 20 AND n_rows > 50 THEN 'categorical'
 WHEN kind = 'numeric' THEN 'numeric'
 WHEN coalesce(datetime_rate, 0) >= 0.8 THEN 'datetime'
 WHEN kind = 'string' AND n_unique = n_rows AND n_rows > 10 THEN 'identifier'
 WHEN kind = 'string' AND (n_unique <= 30 OR (CAST(n_unique AS DOUBLE) / n_rows < 0.05 AND n_rows > 100)) THEN 'categorical'
 WHEN kind = 'string' AND avg_len > 50 THEN 'text'
 WHEN kind = 'string' THEN 'categorical' ELSE 'unknown' END"""


def targets() -> str:
    """A CTE ``targets`` over ``facts``: score, reasons and rank of target candidates."""
    words = ", ".join(f"({i}, '{k}')" for i, k in enumerate(TARGET_KEYWORDS))
    minority = "CAST(minority_cnt AS DOUBLE) / n_nonnull * 100"
    return f"""keywords AS (SELECT * FROM (VALUES {words}) AS w(place, word)),
named AS (SELECT f.*, (SELECT arg_min(word, place) FROM keywords WHERE contains(lower(f.col), word)) AS word FROM facts f),
targets AS (SELECT * FROM (SELECT *,
  CAST((CASE WHEN word IS NOT NULL THEN 3 ELSE 0 END)
   + (CASE WHEN n_unique = 2 THEN 2 WHEN n_unique > 2 AND n_unique <= 10 AND n_rows > 50 THEN 1 ELSE 0 END)
   + (CASE WHEN n_unique = 2 AND {minority} < 30 THEN 1 ELSE 0 END) AS INTEGER) AS score,
  concat_ws('; ', CASE WHEN word IS NOT NULL THEN concat('Name contains ''', word, '''') END,
   CASE WHEN n_unique = 2 THEN 'Binary column (2 unique values)' END,
   CASE WHEN n_unique = 2 AND {minority} < 30 THEN concat('Imbalanced (', printf('%.1f', {minority}), '% minority class)') END,
   CASE WHEN n_unique > 2 AND n_unique <= 10 AND n_rows > 50 THEN concat('Low cardinality (', n_unique, ' classes)') END)
   AS reasons
  FROM named) WHERE score >= 2)"""


def missing(view: str) -> str:
    rows = [
        f"SELECT '{c}' AS col, {i} AS position, count(*) - count({c}) AS missing_count, count(*) AS n_rows FROM {view}"
        for i, (c, _) in enumerate(COLUMNS[view])
    ]
    return f"""missing AS (SELECT *, CASE WHEN missing_pct = 0 THEN 'none' WHEN missing_pct < 5 THEN 'low'
  WHEN missing_pct < 15 THEN 'moderate' WHEN missing_pct < 40 THEN 'high' ELSE 'critical' END AS severity
 FROM (SELECT *, round(CAST(missing_count AS DOUBLE) / n_rows * 100, 2) AS missing_pct FROM ({union(rows)})))"""


def missing_totals(view: str) -> str:
    gaps = " + ".join(f"({c} IS NULL)::INT" for c, _ in COLUMNS[view])
    cols = len(COLUMNS[view])
    return f"""missing_totals AS (SELECT *, round(CAST(total_missing AS DOUBLE) / total_cells * 100, 2) AS overall_pct,
  total_cells // {cols} - rows_with_any_missing AS rows_complete
 FROM (SELECT CAST(sum(g) AS BIGINT) AS total_missing, CAST(count(*) * {cols} AS BIGINT) AS total_cells,
  count(*) FILTER (g > 0) AS rows_with_any_missing FROM (SELECT {gaps} AS g FROM {view})))"""


def duplicates(view: str) -> str:
    return f"""duplicates AS (SELECT *, round(CAST(exact_duplicates AS DOUBLE) / n_rows * 100, 2) AS exact_pct
 FROM (SELECT (SELECT count(*) FROM {view}) AS n_rows,
  (SELECT count(*) FROM {view}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {view})) AS exact_duplicates))"""


def case_groups(view: str) -> str:
    rows = [
        f"SELECT '{c}' AS col, {i} AS position, {c} AS value, count(*) AS cnt, lower({trim(c)}) AS canonical FROM {view} WHERE {c} IS NOT NULL GROUP BY {c}"
        for i, (c, t) in enumerate(COLUMNS[view])
        if t == "string"
    ]
    return f"""variants AS ({union(rows)}),
case_groups AS (SELECT col, canonical, CAST(sum(cnt) AS BIGINT) AS total FROM variants GROUP BY 1, 2 HAVING count(*) > 1)"""


def affected(view: str, test: str) -> str:
    rows = [
        f"SELECT '{c}' AS col, {position(view, c)} AS position, count(*) FILTER ({test.replace('$c', c)}) AS affected_count FROM {view}"
        for c in strings(view)
    ]
    return f"(SELECT * FROM ({union(rows)}) WHERE affected_count > 0)"


SPACE_TEST = rf"regexp_matches($c, '{EDGE}')"
EMPTY_TEST = f"{trim('$c')} = ''"


def issues(view: str) -> str:
    return f"""{case_groups(view)},
issues AS (SELECT col, min(position) AS position, count(*) AS issue_count, string_agg(issue, ', ' ORDER BY place) AS issues
 FROM (SELECT col, position, 1 AS place, 'whitespace' AS issue FROM {affected(view, SPACE_TEST)}
  UNION ALL SELECT DISTINCT v.col, v.position, 2, 'mixed_case' FROM variants v JOIN case_groups g ON v.col = g.col
  UNION ALL SELECT col, position, 3, 'empty_strings' FROM {affected(view, EMPTY_TEST)}) GROUP BY col)"""


def outliers(view: str) -> str:
    rows = []
    for c in numbers(view):
        rows.append(f"""
SELECT '{c}' AS col, {position(view, c)} AS position, count(x) AS n, count(*) FILTER (x < lo OR x > hi) AS outlier_count,
 min(x) AS min_val, max(x) AS max_val, any_value(lo) AS lower_bound, any_value(hi) AS upper_bound, any_value(iqr) AS iqr
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {view}),
 (SELECT q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi, q3 - q1 AS iqr
  FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {view}))""")
    return f"""outliers AS (SELECT *, CASE WHEN outlier_pct = 0 THEN 'none' WHEN outlier_pct < 2 THEN 'low'
  WHEN outlier_pct < 5 THEN 'moderate' WHEN outlier_pct < 15 THEN 'high' ELSE 'extreme' END AS severity
 FROM (SELECT *, round(CAST(outlier_count AS DOUBLE) / n * 100, 2) AS outlier_pct FROM ({union(rows)})
  WHERE n >= 10 AND iqr <> 0))"""


def imbalance() -> str:
    who = "concat(CASE WHEN is_target THEN 'Target column ''' ELSE 'Column ''' END, col, '''')"
    return f"""imbalance AS (SELECT *, CASE severity
   WHEN 'balanced' THEN concat('''', col, ''' has well-balanced class distribution.')
   WHEN 'mild' THEN concat({who}, ' shows mild imbalance. Standard ML models should handle this.')
   WHEN 'moderate' THEN concat({who}, ' has moderate imbalance. Consider stratified sampling or class weights.')
   WHEN 'severe' THEN concat({who}, ' is severely imbalanced. Use SMOTE, class weights, or specialized techniques.')
   ELSE concat({who}, ' has extreme imbalance. Anomaly detection approach may be more appropriate than classification.')
  END AS recommendation
 FROM (SELECT *, CASE WHEN ratio < 1.5 THEN 'balanced' WHEN ratio < 3 THEN 'mild' WHEN ratio < 10 THEN 'moderate'
   WHEN ratio < 50 THEN 'severe' ELSE 'extreme' END AS severity
  FROM (SELECT *, round(CAST(majority_cnt AS DOUBLE) / minority_cnt, 2) AS ratio,
    col IN (SELECT col FROM targets) AS is_target FROM facts)
  WHERE n_unique >= 2 AND (is_target OR n_unique <= 15)))"""


def score(view: str) -> str:
    """CTEs up to ``score`` with one row."""
    return f"""{missing_totals(view)}, {duplicates(view)}, {issues(view)}, {outliers(view)},
dims AS (SELECT
 greatest(0.0::DOUBLE, 25.0::DOUBLE - (SELECT overall_pct FROM missing_totals) * 0.5::DOUBLE) AS a,
 greatest(0.0::DOUBLE, 25.0::DOUBLE - (SELECT exact_pct FROM duplicates) * 0.5::DOUBLE) AS b,
 greatest(0.0::DOUBLE, 25.0::DOUBLE - coalesce((SELECT sum(issue_count) FROM issues), 0)::DOUBLE * 2) AS c,
 greatest(0.0::DOUBLE, 25.0::DOUBLE - coalesce((SELECT avg(outlier_pct) FROM outliers WHERE outlier_count > 0), 0) * 1.5::DOUBLE) AS d),
score AS (SELECT *, CASE WHEN total >= 90 THEN 'A' WHEN total >= 75 THEN 'B' WHEN total >= 60 THEN 'C'
  WHEN total >= 40 THEN 'D' ELSE 'F' END AS grade
 FROM (SELECT round(a, 1) AS completeness, round(b, 1) AS uniqueness, round(c, 1) AS consistency, round(d, 1) AS validity,
  round(a + b + c + d, 1) AS total FROM dims))"""


def shapes(view: str) -> str:
    """A CTE ``shapes``: moments and quartiles per numeric column."""
    rows = [
        f"""SELECT '{c}' AS col, {position(view, c)} AS position, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std,
 var_samp(x) AS variance, min(x) AS low, max(x) AS high, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median,
 quantile_cont(x, 0.75) AS q75, skewness(x) AS skew, kurtosis(x) AS kurt, kurtosis_pop(x) AS g2
 FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {view})"""
        for c in numbers(view)
    ]
    return f"shapes AS ({union(rows)})"


def normality(view: str) -> str:
    """A CTE ``normal`` with p-value and distribution class per numeric column of at least twenty values."""
    return f"""{shapes(view)},
t1 AS (SELECT *, CAST(n AS DOUBLE) AS m, skew * (n - 2) / sqrt(CAST(n AS DOUBLE) * (n - 1)) AS g1 FROM shapes WHERE n >= 20),
t2 AS (SELECT *, g1 * sqrt((m + 1) * (m + 3) / (6 * (m - 2))) AS y0,
 3 * (m * m + 27 * m - 70) * (m + 1) * (m + 3) / ((m - 2) * (m + 5) * (m + 7) * (m + 9)) AS beta,
 3 * (m - 1) / (m + 1) AS e, 24 * m * (m - 2) * (m - 3) / ((m + 1) * (m + 1) * (m + 3) * (m + 5)) AS v,
 6 * (m * m - 5 * m + 2) / ((m + 7) * (m + 9)) * sqrt(6 * (m + 3) * (m + 5) / (m * (m - 2) * (m - 3))) AS s FROM t1),
t3 AS (SELECT *, CASE WHEN y0 = 0 THEN 1 ELSE y0 END AS y, sqrt(2 * (beta - 1)) - 1 AS w2,
 (g2 + 3 - e) / sqrt(v) AS x, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a FROM t2),
t4 AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2 / (w2 - 1)) AS alpha, 1 + x * sqrt(2 / (a - 4)) AS d FROM t3),
t5 AS (SELECT *, delta * ln(y / alpha + sqrt((y / alpha) * (y / alpha) + 1)) AS zs,
 (1 - 2 / (9 * a) - sign(d) * cbrt((1 - 2 / a) / abs(d))) / sqrt(2 / (9 * a)) AS zk FROM t4),
normal AS (SELECT *, CASE WHEN p > 0.05 AND abs(skew) < 0.5 THEN 'normal' WHEN abs(skew) < 0.5 THEN 'approximately symmetric'
  WHEN skew > 2 THEN 'highly right-skewed' WHEN skew > 0.5 THEN 'right-skewed' WHEN skew < -2 THEN 'highly left-skewed'
  WHEN skew < -0.5 THEN 'left-skewed' WHEN kurt > 5 THEN 'heavy-tailed' ELSE 'approximately symmetric' END AS shape
 FROM (SELECT *, exp(-(zs * zs + zk * zk) / 2) AS p FROM t5))"""


def pairs(view: str) -> str:
    rows = [
        f"SELECT '{a}' AS col1, '{b}' AS col2, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r, {i} AS position FROM {view}"
        for i, (a, b) in enumerate(combinations(numbers(view), 2))
    ]
    return f"""pairs AS ({union(rows)}),
report AS (SELECT col1, col2, round(r, 4) AS correlation, position, r, CASE WHEN abs(r) >= 0.9 THEN 'very strong'
  WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'negligible' END AS strength
 FROM pairs)"""


def top_pairs(top: int) -> str:
    return f"""top_pairs AS ((SELECT 'positive' AS direction, * FROM report WHERE correlation > 0 ORDER BY correlation DESC, position LIMIT {top})
 UNION ALL (SELECT 'negative' AS direction, * FROM report WHERE correlation < 0 ORDER BY correlation, position DESC LIMIT {top}))"""


def importance_scores(view: str, target: str, classification: bool, digits: int) -> str:
    """A CTE ``scores`` with the plug-in information of every other column, cut at the same quantiles."""

    def as_number(c: str, t: str) -> str:
        return f"CAST({c} AS DOUBLE)" if t in NUMBERS else f"CAST(epoch_us({c}) AS DOUBLE)"

    types = dict(COLUMNS[view])
    cut = [c for c, t in COLUMNS[view] if t != "string" and (c != target or not classification)]
    points = ", ".join(str(i / 20) for i in range(1, 20))
    quantiles = ", ".join(f"quantile_cont({as_number(c, types[c])}, [{points}]) AS q_{c}" for c in cut)

    def key(c: str) -> str:
        if c not in cut:
            return f"CAST({c} AS VARCHAR)"
        value = as_number(c, types[c])
        return f"CAST(len(list_filter(list_distinct(q_{c}), lambda q: q < {value})) AS VARCHAR)"

    features = [c for c, _ in COLUMNS[view] if c != target]
    keep = " AND ".join(f"{c} IS NOT NULL" for c, _ in COLUMNS[view])
    keyed = ", ".join(f"{key(c)} AS k_{c}" for c, _ in COLUMNS[view])
    cells = union(
        [
            f"SELECT '{c}' AS feature, {position(view, c)} AS position, k_{c} AS x, k_{target} AS y, count(*) AS c FROM keyed GROUP BY ALL"
            for c in features
        ]
    )
    return f"""cuts AS (SELECT {quantiles} FROM {view} WHERE {keep}),
keyed AS (SELECT {keyed} FROM {view}, cuts WHERE {keep}),
cells AS ({cells}),
parts AS (SELECT feature, position, sum(c * ln(c)) AS sxy, count(*) AS kxy, CAST(sum(c) AS DOUBLE) AS n FROM cells GROUP BY 1, 2),
of_x AS (SELECT feature, sum(c * ln(c)) AS sx, count(*) AS kx FROM (SELECT feature, x, sum(c) AS c FROM cells GROUP BY 1, 2) GROUP BY 1),
of_y AS (SELECT feature, sum(c * ln(c)) AS sy, count(*) AS ky FROM (SELECT feature, y, sum(c) AS c FROM cells GROUP BY 1, 2) GROUP BY 1),
scores AS (SELECT feature, round(greatest(0.0, ln(n) + (sxy - sx - sy) / n), {digits}) AS score,
 round(ln(n) + (sxy - sx - sy) / n - (kxy - kx - ky + 1) / (2 * n), {digits}) AS score_corrected, position
 FROM parts JOIN of_x USING (feature) JOIN of_y USING (feature))"""


def neighbour_scores(view: str, target: str, classification: bool, digits: int, k: int = 3) -> str:
    """A CTE ``scores`` with the nearest-neighbour information of every other column, from all pairs of rows."""
    types = dict(COLUMNS[view])
    features = [c for c, _ in COLUMNS[view] if c != target]
    keep = " AND ".join(f"{c} IS NOT NULL" for c in types)
    axes = ", ".join(
        f"CAST({c} AS DOUBLE) / coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0), 1) AS z_{c}"
        for c, t in types.items()
        if t in NUMBERS
    )

    def count(of: str, v: str) -> str:
        return f"(SELECT count(*) FROM {of} b WHERE abs(b.{v} - r.{v}) <= r.r * (1 - 1e-9))"

    def psi(n: str) -> str:
        return f"(SELECT psi FROM psis WHERE psis.n = {n})"

    def discrete(c: str, x: str, y: str) -> tuple[str, str]:
        ctes = f"""p_{c} AS (SELECT i, z_{x} AS x, {y} AS y, count(*) OVER (PARTITION BY {y}) AS size FROM d),
m_{c} AS (SELECT * FROM p_{c} WHERE size > 1),
n_{c} AS (SELECT a.i, a.x, a.size, abs(a.x - b.x) AS dist,
 row_number() OVER (PARTITION BY a.i ORDER BY abs(a.x - b.x)) AS place FROM m_{c} a JOIN m_{c} b ON a.y = b.y AND a.i <> b.i),
r_{c} AS (SELECT x, size, dist AS r FROM n_{c} WHERE place = least({k}, size - 1)),
c_{c} AS (SELECT size, {count(f"m_{c}", "x")} AS near FROM r_{c} r)"""
        return ctes, f"""(SELECT {psi(f"(SELECT count(*) FROM m_{c})")} + avg({psi(f"least({k}, size - 1)")}) - avg({psi("size")}) - avg({psi("near")}) FROM c_{c})"""

    def continuous(c: str) -> tuple[str, str]:
        ctes = f"""p_{c} AS (SELECT i, z_{c} AS x, z_{target} AS y FROM d),
n_{c} AS (SELECT a.i, a.x, a.y, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS dist,
 row_number() OVER (PARTITION BY a.i ORDER BY greatest(abs(a.x - b.x), abs(a.y - b.y))) AS place FROM p_{c} a JOIN p_{c} b ON a.i <> b.i),
r_{c} AS (SELECT x, y, dist AS r FROM n_{c} WHERE place = {k}),
c_{c} AS (SELECT {count(f"p_{c}", "x")} AS x, {count(f"p_{c}", "y")} AS y FROM r_{c} r)"""
        return ctes, f"""(SELECT {psi("(SELECT count(*) FROM d)")} + {psi(str(k))} - avg({psi("x")}) - avg({psi("y")}) FROM c_{c})"""

    def counted(c: str) -> tuple[str, str]:
        both = f"SELECT {c} AS x, {target} AS y, CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY ALL"
        return f"p_{c} AS ({both})", f"""(SELECT sum(c / n * ln(c * n / (sx * sy))) FROM (SELECT c, sum(c) OVER () AS n,
 sum(c) OVER (PARTITION BY x) AS sx, sum(c) OVER (PARTITION BY y) AS sy FROM p_{c}))"""

    parts, rows = [], []
    for c in features:
        number = types[c] in NUMBERS
        if classification:
            cte, score = discrete(c, c, target) if number else counted(c)
        else:
            cte, score = continuous(c) if number else discrete(c, target, c)
        parts.append(cte)
        rows.append(f"SELECT '{c}' AS feature, round(greatest(0.0, {score}), {digits}) AS score, CAST({position(view, c)} AS INTEGER) AS position")
    return f"""d AS (SELECT row_number() OVER () AS i, *, {axes} FROM {view} WHERE {keep}),
psis AS (SELECT n, coalesce(sum(1.0::DOUBLE / (n - 1)) FILTER (n > 1) OVER (ORDER BY n), 0) - 0.5772156649015329 AS psi
 FROM (SELECT unnest(range(1, (SELECT count(*) + 2 FROM d))) AS n)),
{", ".join(parts)},
scores AS ({union(rows)})"""


def histogram(view: str, columns: list[str]) -> str:
    rows = [
        f"""SELECT '{c}' AS col, b.bin AS bin, lo + (hi - lo) * b.bin / 30 AS bin_start, lo + (hi - lo) * (b.bin + 1) / 30 AS bin_end,
 (SELECT count(*) FROM {view} WHERE least(CAST(floor((CAST({c} AS DOUBLE) - lo) / (hi - lo) * 30) AS INTEGER), 29) = b.bin) AS cnt
 FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {view}), (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) b"""
        for c in columns
    ]
    return f"hist AS ({union(rows)})"


def clean_ctes() -> str:
    """CTEs ``kept`` (no empty rows), ``trimmed`` and ``cleaned`` of the dirty orders."""
    columns = [c for c, _ in COLUMNS[DIRTY]]
    some = " OR ".join(f"{c} IS NOT NULL" for c in columns)
    texts = set(strings(DIRTY))
    cut = ", ".join(f"{trim(c)} AS {c}" if c in texts else c for c in columns)
    return f"""kept AS (SELECT * FROM {DIRTY} WHERE {some}),
trimmed AS (SELECT {cut} FROM kept),
priority AS (SELECT o_orderpriority AS v FROM trimmed WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
cleaned AS (SELECT o_orderkey,
  coalesce(CAST(o_custkey AS DOUBLE), (SELECT median(CAST(o_custkey AS DOUBLE)) FROM kept)) AS o_custkey, o_orderstatus,
  coalesce(o_totalprice, (SELECT median(o_totalprice) FROM kept)) AS o_totalprice,
  coalesce(o_orderpriority, (SELECT v FROM priority)) AS o_orderpriority, o_orderdate FROM trimmed)"""


def sample_list(view: str) -> str:
    """A CTE ``samples``: the three smallest distinct values per column, joined."""
    rows = [
        f"SELECT '{c}' AS col, string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) AS sample_values FROM (SELECT DISTINCT {c} AS v FROM {view} WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)"
        for c, _ in COLUMNS[view]
    ]
    return f"samples AS ({union(rows)})"


def profile_ctes(view: str) -> str:
    return f"""{facts(view)}, {sample_list(view)},
profile AS (SELECT f.col, position, data_type, {semantic()} AS semantic_type, n_unique,
 round(CAST(n_unique AS DOUBLE) / n_rows, 4) AS uniqueness_ratio, n_rows - n_nonnull AS null_count,
 round(CAST(n_rows - n_nonnull AS DOUBLE) / n_rows * 100, 2) AS null_pct, sample_values
 FROM facts f LEFT JOIN samples s ON f.col = s.col)"""


def time_rows() -> str:
    hits = " OR ".join(f"contains(lower(col), '{k}')" for k in TIME_KEYWORDS)
    return f"""times AS (SELECT col, position, n_unique, {hits} AS name_hit FROM facts
 WHERE kind = 'datetime' OR (kind = 'string' AND coalesce(datetime_rate, 0) >= 0.8))"""


def entry_rows(section: str, source: str, title: str, description: str, level: str, detail: str) -> str:
    """The entries of one list of the responses as rows, numbered in their order."""
    return f"""SELECT item_id, '{section}' AS section, CAST(number AS INTEGER) AS number, {title} AS title,
 coalesce(e->>'{description}', '') AS description, coalesce(e->>'{level}', '') AS level, {detail} AS detail
 FROM (SELECT item_id, unnest(CAST(j->'$.{source}' AS JSON[])) AS e, generate_subscripts(CAST(j->'$.{source}' AS JSON[]), 1) AS number
       FROM parsed WHERE path <> 'fallback')"""


def frequency(column: str, view: str) -> str:
    """The median gap between the times of a column (or expression AS name) and the name of their frequency."""
    return f"""SELECT '{column}' AS "column", n_records, g AS median_gap_us,
 CASE WHEN d = 0 AND g < 3600000000 THEN 'sub-hourly' WHEN d = 0 AND g <= 5400000000 THEN 'hourly' WHEN d = 0 THEN 'intra-day'
  WHEN d = 1 THEN 'daily' WHEN d BETWEEN 6 AND 8 THEN 'weekly' WHEN d BETWEEN 13 AND 16 THEN 'bi-weekly'
  WHEN d BETWEEN 27 AND 33 THEN 'monthly' WHEN d BETWEEN 85 AND 95 THEN 'quarterly' WHEN d BETWEEN 360 AND 370 THEN 'yearly'
  ELSE concat('~', d, '-day intervals') END AS frequency
 FROM (SELECT count(*) AS n_records, CAST(median(gap) AS DOUBLE) AS g, CAST(floor(median(gap) / 86400000000.0) AS BIGINT) AS d
  FROM (SELECT epoch_us({column}) - lag(epoch_us({column})) OVER (ORDER BY {column}) AS gap FROM {view} WHERE {column} IS NOT NULL))
 WHERE n_records >= 3"""


def steps(column: str, view: str, step: str) -> str:
    return frequency(step, f"(SELECT DISTINCT CAST(date_trunc('{step}', {column}) AS TIMESTAMP) AS {step} FROM {view})")


def clean_oracles() -> dict[str, str]:
    columns = ", ".join(c for c, _ in COLUMNS[DIRTY])
    return {
        "csv_source": """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment,
 concat(c_mktsegment, ' né à Köln') AS note FROM customer""",
        "normalize_names": """SELECT o_orderkey AS order_key, o_custkey AS order_key_1, o_orderstatus AS status_x,
 o_totalprice AS price_usd, o_orderdate AS order_key_2, o_orderpriority AS order_priority FROM orders""",
        "clean_drop_empty_rows": with_(DIRTY, "SELECT * FROM kept", clean_ctes()),
        "clean_median_impute": with_(
            DIRTY,
            """SELECT o_orderkey, coalesce(CAST(o_custkey AS DOUBLE), (SELECT median(CAST(o_custkey AS DOUBLE)) FROM kept)) AS o_custkey,
 o_orderstatus, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM kept)) AS o_totalprice, o_orderpriority, o_orderdate FROM kept""",
            clean_ctes(),
        ),
        "clean_trim": with_(
            DIRTY,
            f"SELECT o_orderkey, o_custkey, {trim('o_orderstatus')} AS o_orderstatus, o_totalprice, {trim('o_orderpriority')} AS o_orderpriority, o_orderdate FROM {DIRTY}",
        ),
        "clean_mode_impute": with_(
            DIRTY,
            """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
 coalesce(o_orderpriority, (SELECT v FROM priority)) AS o_orderpriority, o_orderdate FROM trimmed""",
            clean_ctes(),
        ),
        "clean_table": with_(DIRTY, f"SELECT {columns} FROM cleaned", clean_ctes()),
        # From CSV an empty text is a missing value and a date is text.
        "load_analyse_clean": with_(
            DIRTY,
            """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
 coalesce(nullif(p, ''), (SELECT nullif(p, '') FROM csv WHERE nullif(p, '') IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority,
 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM csv""",
            clean_ctes(),
            """csv AS (SELECT c.* EXCLUDE (o_orderpriority), t.o_orderpriority AS p FROM
 (SELECT *, row_number() OVER () AS i FROM cleaned) c JOIN (SELECT *, row_number() OVER () AS i FROM trimmed) t USING (i))""",
        ),
    }


def schema_oracles() -> dict[str, str]:
    semantic_rows = f'SELECT col AS "column", position, data_type, {semantic()} AS semantic_type FROM facts'
    every = ", ".join(
        f"('{t}')" for t in ("numeric", "categorical", "datetime", "boolean", "text", "identifier", "unknown")
    )
    lexical = union(
        [
            f"""SELECT '{c}' AS "column", CASE WHEN regexp_full_match({c}, '\\s*[+-]?\\d+\\s*') THEN 'int'
 WHEN regexp_full_match({c}, '{NUMERIC}') THEN 'float' WHEN lower({trim(c)}) IN ('true', 'false', 'yes', 'no') THEN 'bool'
 WHEN regexp_full_match({c}, '{DATE}') AND try_cast({c} AS TIMESTAMP) IS NOT NULL THEN 'date' ELSE 'text' END AS lexical_type,
 count(*) AS cnt FROM events_text WHERE {c} IS NOT NULL GROUP BY ALL"""
            for c in strings("events_text")
        ]
    )
    return {
        "column_type_split": with_(
            DIRTY,
            """SELECT col AS "column", position, CASE WHEN kind = 'numeric' THEN 'numeric' ELSE 'categorical' END AS role
 FROM facts WHERE kind = 'numeric' OR (kind = 'string' AND n_unique < 30)""",
            facts(DIRTY),
        ),
        "dataset_shape": with_(
            DIRTY,
            f"""SELECT count(*) AS rows, CAST({len(COLUMNS[DIRTY])} AS BIGINT) AS cols,
 concat('This dataset has ', format('{{:,}}', count(*)), ' rows and {len(COLUMNS[DIRTY])} columns.') AS description FROM {DIRTY}""",
        ),
        "basic_schema": with_(
            DIRTY,
            'SELECT col AS "column", data_type, n_nonnull AS non_null_count, n_unique AS unique_values FROM facts',
            facts(DIRTY),
        ),
        "column_profile": with_(DIRTY, 'SELECT col AS "column", * EXCLUDE (col) FROM profile', profile_ctes(DIRTY)),
        "semantic_types": with_("events_text", semantic_rows, facts("events_text")),
        "semantic_types_part": with_("part", semantic_rows, facts("part")),
        "datetime_parse_rate": with_(
            "events_text",
            """SELECT col AS "column", position, CAST(datetime_rate AS DOUBLE) AS parse_rate, datetime_rate >= 0.8 AS is_datetime FROM facts""",
            facts("events_text"),
        ),
        "mixed_columns": with_(
            "events_text",
            """SELECT col AS "column", position, 'str (mixed numeric/text)' AS types_found,
 round(numeric_rate * 100, 1) AS numeric_parseable_pct FROM facts WHERE numeric_rate > 0.3 AND numeric_rate < 0.95""",
            facts("events_text"),
        ),
        "mixed_samples": with_(
            "events_text",
            f"""SELECT col AS "column", is_numeric, CAST(sum(cnt) AS BIGINT) AS n_values,
 string_agg(value, ', ' ORDER BY value) FILTER (place <= 3) AS samples
 FROM (SELECT *, row_number() OVER (PARTITION BY col, is_numeric ORDER BY value) AS place FROM
  (SELECT col, regexp_full_match(value, '{NUMERIC}') AS is_numeric, value, count(*) AS cnt FROM
   ({" UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value FROM events_text WHERE {c} IS NOT NULL" for c in strings("events_text"))})
   WHERE col IN (SELECT col FROM facts WHERE numeric_rate > 0.3 AND numeric_rate < 0.95) GROUP BY ALL)) GROUP BY ALL""",
            facts("events_text"),
        ),
        "lexical_type_counts": with_("events_text", lexical),
        "target_candidates": with_(
            "docs_labeled",
            'SELECT col AS "column", position, score, reasons, n_unique, data_type FROM targets',
            facts("docs_labeled"),
            targets(),
        ),
        "primary_keys": with_(
            "part",
            """SELECT col AS "column", position, data_type, coalesce(is_integer AND high - low + 1 = n_rows, false) AS is_sequential, is_integer,
 CASE WHEN (is_integer AND high - low + 1 = n_rows) OR (kind = 'string' AND min_len = max_len AND n_rows > 1) THEN 'very_high' ELSE 'high' END AS confidence
 FROM facts WHERE n_unique = n_rows AND n_nonnull = n_rows""",
            facts("part"),
        ),
        "primary_keys_ordered": union(
            [
                f"""(WITH {facts(view)}, rising AS ({union([f"""SELECT '{c}' AS col, bool_and(prev IS NULL OR low > prev) AS rises FROM
 (SELECT min({c}) AS low, lag(max({c})) OVER (ORDER BY {by}) AS prev FROM {view} GROUP BY {by})""" for c, t in COLUMNS[view] if t in INTEGERS])})
 SELECT '{view}' AS table_name, col AS "column", position, data_type, coalesce(rises, false) AS is_sequential, is_integer,
 CASE WHEN rises OR (kind = 'string' AND min_len = max_len AND n_rows > 1) THEN 'very_high' ELSE 'high' END AS confidence
 FROM facts LEFT JOIN rising USING (col) WHERE n_unique = n_rows AND n_nonnull = n_rows)"""
                for view, by in (("events", "ts"), ("orders", "o_orderdate"), ("part", "p_partkey"))
            ]
        ),
        "best_time_column": with_(
            "events_text",
            """SELECT col AS "column", position, n_unique, name_hit,
 row_number() OVER (ORDER BY NOT name_hit, CASE WHEN name_hit THEN 0 ELSE -n_unique END, position) = 1 AS is_best FROM times""",
            facts("events_text"),
            time_rows(),
        ),
        "temporal_span": """SELECT 'ts' AS "column", min(ts) AS start_ts, max(ts) AS end_ts,
 CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) AS BIGINT) AS duration_days, count(ts) AS n_records FROM events""",
        "time_frequency": f"{frequency('ts', 'events')} UNION ALL {frequency('l_shipdate', 'lineitem')}",
        "time_frequency_steps": union(
            [steps("ts", "events", "hour")]
            + [steps("o_orderdate", "orders", step) for step in ("day", "week", "month", "quarter", "year")]
        ),
        "column_categories": with_(
            DIRTY,
            f"""SELECT e.semantic_type, count(t.col) AS n_columns, coalesce(string_agg(t.col, ', ' ORDER BY t.position), '') AS columns
 FROM (VALUES {every}) AS e(semantic_type) LEFT JOIN (SELECT col, position, {semantic()} AS semantic_type FROM facts) t
 ON e.semantic_type = t.semantic_type GROUP BY 1""",
            facts(DIRTY),
        ),
        "schema_report": with_(
            DIRTY,
            """SELECT col AS "column", data_type AS storage_type, concat(upper(semantic_type[1]), semantic_type[2:]) AS semantic_type,
 n_unique AS unique_values, printf('%.1f%%', uniqueness_ratio * 100) AS uniqueness_pct, null_count AS nulls,
 printf('%.2f%%', null_pct) AS null_pct, sample_values FROM profile""",
            profile_ctes(DIRTY),
        ),
    }


def quality_oracles() -> dict[str, str]:
    names = "string_agg(col, ', ' ORDER BY missing_count DESC, position)"
    repeats = union(
        [
            f"SELECT '{c}' AS col, {position(DIRTY, c)} AS position, count(*) - count(DISTINCT {c}) - max(({c} IS NULL)::INT) AS duplicates, count(*) AS n_rows FROM {DIRTY}"
            for c, t in COLUMNS[DIRTY]
            if t not in NUMBERS
        ]
    )
    bounds = ", ".join(f"round({c}, 6) AS {c}" for c in ("lower_bound", "upper_bound", "min_val", "max_val"))
    extremes = union(
        [
            f"""SELECT * FROM (SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY greatest(lower_bound - x, x - upper_bound) DESC, x) AS INTEGER) AS rank,
 round(x, 4) AS value FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {DIRTY}), (SELECT lower_bound, upper_bound FROM outliers WHERE col = '{c}')
 WHERE x < lower_bound OR x > upper_bound) WHERE rank <= 5"""
            for c in numbers(DIRTY)
        ]
    )
    classes = union(
        [
            f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "class", count(*) AS cnt,
 round(CAST(count(*) AS DOUBLE) / (SELECT count({c}) FROM docs_labeled) * 100, 1) AS pct
 FROM docs_labeled WHERE {c} IS NOT NULL AND '{c}' IN (SELECT col FROM imbalance) GROUP BY {c}"""
            for c, _ in COLUMNS["docs_labeled"]
        ]
    )
    labeled = (facts("docs_labeled"), targets(), imbalance())

    def long(section: str, source: str, item: str, metrics: list[str]) -> str:
        return union(
            [
                f"SELECT '{section}' AS section, {item} AS item, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}"
                for m in metrics
            ]
        )

    return {
        "missing_values": with_(
            DIRTY, 'SELECT col AS "column", position, missing_count, missing_pct, severity FROM missing', missing(DIRTY)
        ),
        "missing_display": with_(
            DIRTY,
            """SELECT col AS "column", missing_count AS missing, printf('%.2f%%', missing_pct) AS pct_missing,
 concat(upper(severity[1]), severity[2:]) AS severity FROM missing WHERE missing_count > 0""",
            missing(DIRTY),
        ),
        "outlier_display": with_(
            DIRTY,
            """SELECT col AS "column", outlier_count AS outliers, printf('%.2f%%', outlier_pct) AS pct_outlier,
 round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound,
 concat(upper(severity[1]), severity[2:]) AS severity FROM outliers WHERE outlier_count > 0""",
            outliers(DIRTY),
        ),
        "missing_summary": with_(
            DIRTY,
            f"""SELECT total_missing, total_cells, overall_pct, rows_with_any_missing, rows_complete,
 (SELECT CASE WHEN count(*) = 0 THEN 'No missing values detected — dataset is fully complete.'
  WHEN count(*) <= 3 THEN concat('Missing values concentrated in ', count(*), ' column(s): ', {names}, '.')
  ELSE concat('Missing values spread across ', count(*), ' columns — may indicate systemic data collection issues.') END
  FROM missing WHERE missing_count > 0) AS pattern_summary FROM missing_totals""",
            missing(DIRTY),
            missing_totals(DIRTY),
        ),
        "duplicate_rows": with_(
            DIRTY,
            """SELECT *, CASE WHEN exact_duplicates = 0 THEN 'No exact duplicate rows found. Data appears clean.'
 WHEN exact_pct < 1 THEN concat('Minor duplication: ', exact_duplicates, ' rows (', exact_pct, '%). Likely safe to deduplicate.')
 WHEN exact_pct < 10 THEN concat('Moderate duplication: ', exact_duplicates, ' rows (', exact_pct, '%). Review before removal — could be valid repeated records.')
 ELSE concat('Heavy duplication: ', exact_duplicates, ' rows (', exact_pct, '%). Investigate data pipeline for repeat ingestion.') END AS recommendation FROM duplicates""",
            duplicates(DIRTY),
        ),
        "duplicate_subsets": with_(
            DIRTY,
            f"""SELECT col AS "column", CAST(duplicates AS BIGINT) AS duplicates, round(CAST(duplicates AS DOUBLE) / n_rows * 100, 1) AS pct
 FROM ({repeats}) WHERE duplicates > 0""",
        ),
        "format_whitespace": with_(DIRTY, f'SELECT col AS "column", affected_count FROM {affected(DIRTY, SPACE_TEST)}'),
        "format_empty_strings": with_(DIRTY, f'SELECT col AS "column", affected_count FROM {affected(DIRTY, EMPTY_TEST)}'),
        "format_case_variants": with_(
            DIRTY,
            """SELECT v.col AS "column", v.canonical, v.value AS variant, v.cnt, g.total FROM variants v JOIN
 (SELECT *, row_number() OVER (PARTITION BY col ORDER BY total DESC, canonical) AS place FROM case_groups) g
 ON v.col = g.col AND v.canonical = g.canonical WHERE place <= 5""",
            case_groups(DIRTY),
        ),
        "format_issues": with_(
            DIRTY, 'SELECT col AS "column", position, issue_count, issues FROM issues', issues(DIRTY)
        ),
        "iqr_outliers": with_(
            DIRTY,
            f'SELECT col AS "column", position, outlier_count, outlier_pct, {bounds}, severity FROM outliers',
            outliers(DIRTY),
        ),
        "outlier_summary": with_(
            DIRTY,
            """SELECT CAST(sum(outlier_count) AS BIGINT) AS total_outliers, count(*) FILTER (outlier_count > 0) AS columns_with_outliers,
 CASE WHEN count(*) FILTER (outlier_count > 0) = 0 THEN 'No significant outliers detected across numeric columns.'
 WHEN count(*) FILTER (outlier_count > 0) <= 2 THEN concat('Outliers found in ', count(*) FILTER (outlier_count > 0), ' column(s): ',
  string_agg(concat(col, ' (', outlier_count, ')'), ', ' ORDER BY outlier_count DESC, position) FILTER (outlier_count > 0), '.')
 ELSE concat('Outliers detected in ', count(*) FILTER (outlier_count > 0), ' columns. Total outlier data points: ', sum(outlier_count), '.') END AS summary
 FROM outliers""",
            outliers(DIRTY),
        ),
        "outlier_samples": with_(DIRTY, extremes, outliers(DIRTY)),
        "class_imbalance": with_(
            "docs_labeled",
            """SELECT col AS "column", position, n_unique AS n_classes, majority AS majority_class,
 round(CAST(majority_cnt AS DOUBLE) / n_nonnull * 100, 1) AS majority_pct, minority AS minority_class,
 round(CAST(minority_cnt AS DOUBLE) / n_nonnull * 100, 1) AS minority_pct, ratio AS imbalance_ratio, is_target AS is_target_column,
 severity, recommendation FROM imbalance""",
            *labeled,
        ),
        "class_distribution": with_("docs_labeled", classes, *labeled),
        "quality_score": with_(
            DIRTY, "SELECT completeness, uniqueness, consistency, validity, total, grade FROM score", score(DIRTY)
        ),
        "quality_report": with_(
            DIRTY,
            union(
                [
                    long("missing", "missing", "col", ["missing_count", "missing_pct"]),
                    long(
                        "missing",
                        "missing_totals",
                        "'table'",
                        ["total_missing", "overall_pct", "rows_with_any_missing", "rows_complete"],
                    ),
                    long("duplicates", "duplicates", "'table'", ["exact_duplicates", "exact_pct"]),
                    long("format", "issues", "col", ["issue_count"]),
                    long("outliers", "outliers", "col", ["outlier_count", "outlier_pct"]),
                    long(
                        "imbalance",
                        "(SELECT col, n_unique AS n_classes, ratio AS imbalance_ratio FROM imbalance)",
                        "col",
                        ["n_classes", "imbalance_ratio"],
                    ),
                    long(
                        "score", "score", "'table'", ["completeness", "uniqueness", "consistency", "validity", "total"]
                    ),
                ]
            ),
            missing(DIRTY),
            score(DIRTY),
            facts(DIRTY),
            targets(),
            imbalance(),
        ),
        "chart_missing": with_(
            DIRTY,
            """SELECT col AS "column", missing_count, missing_pct, severity,
 CAST(sum(missing_count) OVER () AS BIGINT) AS total_missing FROM missing WHERE missing_count > 0""",
            missing(DIRTY),
        ),
        "chart_gauge": with_(
            DIRTY,
            "SELECT total, grade, CASE WHEN total < 40 THEN '0-40' WHEN total < 60 THEN '40-60' WHEN total < 75 THEN '60-75' ELSE '75-100' END AS band FROM score",
            score(DIRTY),
        ),
        "chart_dimensions": with_(
            DIRTY,
            union(
                [
                    f"SELECT '{d}' AS dimension, {d} AS points, CAST(25 AS DOUBLE) AS max_points FROM score"
                    for d in ("completeness", "uniqueness", "consistency", "validity")
                ]
            ),
            score(DIRTY),
        ),
        "chart_class_balance": with_(
            "docs_labeled",
            f"""SELECT c."column", c."class", c.pct, round(CAST(100 AS DOUBLE) / n_unique, 6) AS balanced_pct, ratio AS imbalance_ratio, severity,
 is_target AS is_target_column FROM ({classes}) c JOIN (SELECT * FROM imbalance ORDER BY is_target DESC, ratio DESC, position LIMIT 1) i
 ON c."column" = i.col""",
            *labeled,
        ),
        "chart_box": with_(DIRTY, chart_box_body(), clean_ctes(), outliers(DIRTY)),
        "dataset_info": with_(
            DIRTY,
            f"""SELECT (SELECT count(*) FROM kept) AS rows, CAST({len(COLUMNS[DIRTY])} AS BIGINT) AS columns, CAST(1 AS DOUBLE) AS file_size_mb,
 grade AS quality_grade, total AS quality_score, (SELECT count(*) > 0 FROM times) AS has_time_series,
 (SELECT col FROM targets ORDER BY score DESC, position LIMIT 1) AS target_column FROM score""",
            clean_ctes(),
            score(DIRTY),
            facts(DIRTY),
            targets(),
            time_rows(),
        ),
    }


def chart_box_body() -> str:
    rows = []
    for c in numbers(DIRTY):
        rows.append(f"""
SELECT '{c}' AS "column", (SELECT outlier_count FROM outliers WHERE col = '{c}') AS outlier_count, round(any_value(q1), 6) AS q25,
 round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q75, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
 round(min(x) FILTER (x BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)), 6) AS whisker_low,
 round(max(x) FILTER (x BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)), 6) AS whisker_high
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM cleaned), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
 quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM cleaned)""")
    return f"SELECT * FROM ({union(rows)}) WHERE outlier_count > 0"


def stats_oracles() -> dict[str, str]:
    def rounded(digits: int, names: dict[str, str]) -> str:
        return ", ".join(f"round({source}, {digits}) AS {name}" for name, source in names.items())

    moments = {
        "mean": "mean", "std": "std", "min": "low", "q25": "q25", "median": "median", "q75": "q75", "max": "high",
        "skewness": "skew", "kurtosis": "kurt",
    }
    li = numbers("lineitem")
    mi = importance_scores("docs_labeled", "quality", True, 4)
    spread = union(
        [
            f"SELECT '{c}' AS feature, round(var_samp(CAST({c} AS DOUBLE)) / pow(avg({c}), 2), 6) AS score, 'variance' AS basis, {position('lineitem', c)} AS position FROM lineitem"
            for c in li
        ]
        + [
            f"SELECT '{c}' AS feature, round(entropy({c}), 4) AS score, 'entropy' AS basis, {position('lineitem', c)} AS position FROM lineitem"
            for c in strings("lineitem")
        ]
    )
    report_moments = union(
        [
            f"SELECT 'moments' AS section, col AS item, '{m}' AS metric, round({s}, 4) AS value FROM shapes WHERE n >= 3"
            for m, s in (("mean", "mean"), ("std", "std"), ("median", "median"), ("skewness", "skew"), ("kurtosis", "kurt"))
        ]
    )
    mirrored = union(
        [
            "SELECT col1, col2, r FROM pairs",
            "SELECT col2 AS col1, col1 AS col2, r FROM pairs",
            *[f"SELECT '{c}' AS col1, '{c}' AS col2, CAST(1 AS DOUBLE) AS r" for c in li],
        ]
    )
    return {
        "descriptive_stats": with_(
            "lineitem",
            f"""SELECT col AS "column", n AS count, {rounded(6, moments)},
 CASE WHEN mean = 0 THEN 0 ELSE round(std / mean * 100, 2) END AS cv_pct FROM shapes WHERE n >= 3""",
            shapes("lineitem"),
        ),
        "skewed_columns": with_(
            "events",
            """SELECT col AS "column", round(skew, 4) AS skewness, CASE WHEN skew > 0 THEN 'right' ELSE 'left' END AS direction,
 concat('Consider log or sqrt transform for ''', col, '''') AS suggestion FROM shapes WHERE n >= 3 AND abs(skew) > 1""",
            shapes("events"),
        ),
        "high_kurtosis": with_(
            "documents",
            """SELECT col AS "column", round(kurt, 4) AS kurtosis,
 CASE WHEN kurt > 0 THEN 'leptokurtic (heavy tails)' ELSE 'platykurtic (light tails)' END AS type FROM shapes WHERE n >= 3 AND abs(kurt) > 3""",
            shapes("documents"),
        ),
        "normality_test": with_(
            "supplier",
            """SELECT col AS "column", position, n AS n_samples, round(skew, 4) AS skewness, round(kurt, 4) AS kurtosis,
 'D''Agostino-Pearson' AS normality_test, round(p, 6) AS p_value, p > 0.05 AS is_normal, shape AS distribution_type FROM normal""",
            normality("supplier"),
        ),
        "distribution_types": with_(
            "documents",
            'SELECT col AS "column", p > 0.05 AS is_normal, shape AS distribution_type FROM normal',
            normality("documents"),
        ),
        "correlation_matrix": with_(
            "lineitem", f"SELECT col1, col2, round(r, 6) AS r FROM ({mirrored})", pairs("lineitem")
        ),
        "correlation_heatmap": with_(
            "lineitem", f"SELECT col1, col2, round(r, 4) AS r FROM ({mirrored})", pairs("lineitem")
        ),
        "correlation_pairs": with_(
            "lineitem", "SELECT col1, col2, correlation, strength, position FROM report", pairs("lineitem")
        ),
        "correlation_top": with_(
            "lineitem",
            "SELECT direction, col1, col2, correlation, strength, position FROM top_pairs",
            pairs("lineitem"),
            top_pairs(10),
        ),
        "correlation_top15": with_(
            "lineitem",
            "SELECT col1, col2, correlation, strength FROM top_pairs ORDER BY abs(correlation) DESC, position LIMIT 15",
            pairs("lineitem"),
            top_pairs(10),
        ),
        "correlation_summary": with_(
            "lineitem",
            """SELECT count(*) FILTER (abs(correlation) > 0.7) AS strong_count, CASE WHEN count(*) FILTER (abs(correlation) > 0.7) = 0
 THEN 'No strong correlations (|r| > 0.7) found between numeric features.'
 WHEN count(*) FILTER (abs(correlation) > 0.7) <= 3 THEN concat(count(*) FILTER (abs(correlation) > 0.7), ' strong correlation(s) found. Strongest: ',
  first(concat(col1, ' & ', col2, ' (r=', correlation, ').') ORDER BY correlation DESC, position))
 ELSE concat(count(*) FILTER (abs(correlation) > 0.7), ' strong correlations found — possible multicollinearity. Consider feature selection or PCA.') END AS summary
 FROM report""",
            pairs("lineitem"),
        ),
        "chart_corr_pairs": with_(
            "lineitem",
            "SELECT concat(col1, ' × ', col2) AS pair, correlation FROM top_pairs",
            pairs("lineitem"),
            top_pairs(5),
        ),
        "strongest_pair": with_(
            "events",
            "SELECT col1, col2, round(r, 6) AS r FROM pairs ORDER BY abs(r) DESC, position LIMIT 1",
            pairs("events"),
        ),
        "mi_classification": with_(
            "docs_labeled",
            "SELECT feature, score, score_corrected, position FROM scores",
            importance_scores("docs_labeled", "quality", True, 6),
        ),
        "mi_regression": with_(
            "lineitem",
            "SELECT feature, score, score_corrected, position FROM scores",
            importance_scores("lineitem", "l_extendedprice", False, 6),
        ),
        "mi_neighbours_classification": with_(
            "docs_labeled", "SELECT feature, score, position FROM scores", neighbour_scores("docs_labeled", "quality", True, 6)
        ),
        "mi_neighbours_regression": with_(
            "docs_labeled", "SELECT feature, score, position FROM scores", neighbour_scores("docs_labeled", "n_chars", False, 6)
        ),
        "variance_entropy_rank": spread,
        "feature_importance": with_(
            "docs_labeled",
            "SELECT 'mutual_info_classif' AS method, 'quality' AS target_used, feature, score, position FROM scores",
            mi,
        ),
        "chart_importance": with_(
            "docs_labeled",
            "SELECT 'mutual_info_classif' AS method, 'quality' AS target_used, feature, score, position FROM scores ORDER BY score DESC, position LIMIT 10",
            mi,
        ),
        "profiling_report": with_(
            "docs_labeled",
            f"""{report_moments} UNION ALL SELECT 'correlation', concat(col1, ' & ', col2), 'correlation', correlation FROM report
 UNION ALL SELECT 'importance', feature, 'score', score FROM scores""",
            shapes("docs_labeled"),
            pairs("docs_labeled"),
            mi,
        ),
    }


def chart_oracles() -> dict[str, str]:
    li = numbers("lineitem")
    edges = "round(bin_start, 6) AS bin_start, round(bin_end, 6) AS bin_end"
    top = "l_extendedprice"
    series = union(
        [
            f"SELECT date_trunc('hour', ts) AS bucket_start, count(*) AS n_records, '{c}' AS series, round(avg(CAST({c} AS DOUBLE)), 6) AS mean_value FROM events GROUP BY 1"
            for c in ("user_id", "value")
        ]
    )
    return {
        "hist_grid": with_(
            "lineitem", f'SELECT col AS "column", bin, {edges}, cnt FROM hist', histogram("lineitem", li)
        ),
        "hist_top_variance": with_(
            "lineitem",
            f"""SELECT col AS "column", bin, {edges}, cnt, (SELECT round(avg({top}), 6) FROM lineitem) AS mean,
 (SELECT round(stddev_samp({top}), 6) FROM lineitem) AS std, (SELECT count({top}) FROM lineitem) AS n FROM hist""",
            histogram("lineitem", [top]),
        ),
        "composition": """WITH c AS (SELECT p_brand AS k, count(*) AS cnt FROM part GROUP BY 1)
 SELECT k AS "class", cnt, round(CAST(cnt AS DOUBLE) / (SELECT count(*) FROM part) * 100, 6) AS share_pct, count(*) OVER () AS n_classes,
 k = (SELECT k FROM c ORDER BY cnt DESC, k LIMIT 1) AS is_top FROM c""",
        "scatter_points": """WITH e AS (SELECT CAST(min(l_orderkey) AS DOUBLE) AS x0, CAST(max(l_orderkey) AS DOUBLE) AS x1,
  CAST(min(l_partkey) AS DOUBLE) AS y0, CAST(max(l_partkey) AS DOUBLE) AS y1 FROM lineitem),
 cells AS (SELECT least(CAST(floor((CAST(l_orderkey AS DOUBLE) - x0) / (x1 - x0) * 50) AS INTEGER), 49) AS x_bin,
  least(CAST(floor((CAST(l_partkey AS DOUBLE) - y0) / (y1 - y0) * 50) AS INTEGER), 49) AS y_bin, l_returnflag AS "class" FROM lineitem, e)
 SELECT x_bin, y_bin, round(any_value(x0 + (x1 - x0) * x_bin / 50), 6) AS x_start,
  round(any_value(y0 + (y1 - y0) * y_bin / 50), 6) AS y_start, "class", count(*) AS cnt FROM cells, e GROUP BY x_bin, y_bin, cells."class" """,
        "scatter_r": """SELECT 'l_orderkey' AS col1, 'l_partkey' AS col2, count(*) AS n_points,
 round(corr(CAST(l_orderkey AS DOUBLE), CAST(l_partkey AS DOUBLE)), 6) AS r FROM lineitem""",
        "category_mean": """SELECT c_mktsegment AS "class", round(avg(c_acctbal), 6) AS mean_value,
 (SELECT round(avg(c_acctbal), 6) FROM customer) AS overall_mean FROM customer GROUP BY 1""",
        "time_series": series,
    }


def portable(column: tuple[str, str]) -> str:
    name, kind_ = column
    if kind_ in NUMBERS:
        name = f"CAST({name} AS DECIMAL(38,6))"
    elif kind_ != "string":
        name = f"epoch_us({name})"
    return f"coalesce(CAST({name} AS VARCHAR), '')"


CONVERSATION_VIEWS = {"conversation_context": "conversations", "conversation_context_gaps": "conversations_gaps"}


def conversation_oracle(view: str, recent: int = 5, base: str = "", analysed_at: str = "") -> str:
    rule = "=" * 50
    front = f"'{base}', chr(10), " if base else ""
    end = f", chr(10), chr(10), 'Analysis performed at: {analysed_at}'" if analysed_at else ""
    return with_(
        view,
        f"""SELECT conv_id, count(*) AS n_results, concat({front}chr(10), '{rule}', chr(10), 'PREVIOUS ANALYSIS RESULTS', chr(10), '{rule}', chr(10),
  string_agg(concat(chr(10), 'Question: ', question, chr(10), 'Result: ', result), chr(10) ORDER BY turn){end}) AS context
 FROM paired WHERE back <= {recent} GROUP BY 1""",
        f"""spoken AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM {view}
  WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
        """paired AS (SELECT conv_id, turn, text AS question, substring(next_text, 1, 500) AS result,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
  FROM spoken WHERE role = 'user' AND next_role = 'assistant')""",
    )


def context_oracles() -> dict[str, str]:
    described = []
    no_times = ", ".join(f"CAST(NULL AS TIMESTAMP) AS time_{x}" for x in ("mean", "min", "q25", "q50", "q75", "max"))
    for i, (c, t) in enumerate(COLUMNS[DIRTY]):
        us = f"epoch_us({c})"
        quartiles = [f"make_timestamp(CAST(floor(quantile_cont({us}, {q})) AS BIGINT))" for q in (0.25, 0.5, 0.75)]
        times = f"""(SELECT make_timestamp(CAST(floor(avg({us})) AS BIGINT)) AS time_mean, min({c}) AS time_min, {quartiles[0]} AS time_q25,
 {quartiles[1]} AS time_q50, {quartiles[2]} AS time_q75, max({c}) AS time_max FROM {DIRTY})"""
        if t in NUMBERS:
            described.append(
                f"""SELECT '{c}' AS "column", {i} AS position, n AS count, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top,
 CAST(NULL AS BIGINT) AS freq, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS min, round(q25, 6) AS q25,
 round(median, 6) AS q50, round(q75, 6) AS q75, round(high, 6) AS max, {no_times} FROM shapes WHERE col = '{c}'"""
            )
        else:
            described.append(
                f"""SELECT '{c}', {i}, n_nonnull, n_unique, majority, majority_cnt, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
 {"time_mean, time_min, time_q25, time_q50, time_q75, time_max" if kind(t) == "datetime" else no_times}
 FROM facts{f", {times}" if kind(t) == "datetime" else ""} WHERE col = '{c}'"""
            )
    order = ", ".join(f"{c} NULLS FIRST" for c, _ in COLUMNS[DIRTY])
    rule = "=" * 50
    body = "json_extract_string(j, '$.dataset_overview')"
    parsed = """parsed AS (SELECT item_id, path, response, CASE WHEN path <> 'fallback' THEN regexp_extract(response, '(?s)\\{.*\\}') END AS j
 FROM (SELECT *, CASE WHEN starts_with(response, '{') THEN 'plain' WHEN starts_with(response, '```') THEN 'fenced'
  WHEN json_valid(regexp_extract(response, '(?s)\\{.*\\}')) AND regexp_extract(response, '(?s)\\{.*\\}') <> '' THEN 'embedded'
  ELSE 'fallback' END AS path FROM llm_responses))"""
    clean_text = trim("response")
    return {
        "describe_all": with_(DIRTY, union(described), facts(DIRTY), shapes(DIRTY)),
        "context_sample_large": with_(
            DIRTY, f"SELECT * FROM {DIRTY} ORDER BY md5(concat_ws('|', {', '.join(map(portable, COLUMNS[DIRTY]))})), {order} LIMIT 500"
        ),
        "context_sample": with_(DIRTY, f"SELECT * FROM {DIRTY} ORDER BY {order} LIMIT 100"),
        **{name: conversation_oracle(view) for name, view in CONVERSATION_VIEWS.items()},
        "conversation_context_whole": conversation_oracle("conversations_gaps", 2, "Rows: 9", "2024-01-01 10:00:00"),
        "conversation_messages": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'system', turn) AS position,
 role, text AS content FROM conversations""",
        "conversation_queries": """SELECT conv_id, number, query, concat(number, '. ', query, '...') AS caption FROM
 (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, substring(text, 1, 40) AS query
  FROM conversations WHERE role = 'user')""",
        "llm_json_extract": with_(
            "llm_responses",
            f"""SELECT item_id, path AS parse_path, CASE WHEN path = 'fallback' THEN substring({clean_text}, 1, 500) ELSE {body} END AS dataset_overview,
 CASE WHEN path = 'fallback' THEN 0 ELSE len(json_keys(j, '$.key_metrics'))::BIGINT END AS n_metrics,
 CASE WHEN path = 'fallback' THEN 1 ELSE json_array_length(j, '$.insights')::BIGINT END AS n_insights,
 CASE WHEN path = 'fallback' THEN 0 ELSE json_array_length(j, '$.anomalies')::BIGINT END AS n_anomalies,
 CASE WHEN path = 'fallback' THEN 0 ELSE json_array_length(j, '$.recommendations')::BIGINT END AS n_recommendations,
 CASE WHEN path = 'fallback' THEN 'LLM response was not valid JSON. Showing raw text.' END AS parse_warning FROM parsed""",
            parsed,
        ),
        "llm_insight_rows": with_(
            "llm_responses",
            f"""{entry_rows('insight', 'insights', "coalesce(e->>'title', 'Insight')", 'description', 'impact', "coalesce(e->>'category', '')")}
 UNION ALL {entry_rows('anomaly', 'anomalies', "coalesce(e->>'title', 'Anomaly')", 'description', 'severity',
                       "coalesce(array_to_string(CAST(e->'affected_columns' AS VARCHAR[]), ', '), '')")}
 UNION ALL {entry_rows('recommendation', 'recommendations', "coalesce(e->>'action', '')", 'rationale', 'priority', "''")}
 UNION ALL SELECT item_id, 'metric', CAST(number AS INTEGER),
 array_to_string(list_transform(string_split(k, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' '),
 coalesce(json_extract_string(j, '$.key_metrics.' || k), ''), '', ''
 FROM (SELECT item_id, j, unnest(json_keys(j, '$.key_metrics')) AS k, generate_subscripts(json_keys(j, '$.key_metrics'), 1) AS number
       FROM parsed WHERE path <> 'fallback')
 UNION ALL SELECT item_id, 'insight', CAST(1 AS INTEGER), 'Raw Analysis', substring({clean_text}, 1, 1000), 'medium', 'general'
 FROM parsed WHERE path = 'fallback'""",
            parsed,
        ),
    }


def dashboard(found: dict[str, str]) -> str:
    """The charts of the dirty orders and their rows, from the SQL of the charts or from counts over the clean table."""
    nums = ["o_orderkey", "o_custkey", "o_totalprice"]

    def scaled(column: str) -> str:
        value, of = f"CAST({column} AS DOUBLE)", "OVER ()"
        return f"least(CAST(floor(({value} - min({value}) {of}) / (max({value}) {of} - min({value}) {of}) * 50) AS INTEGER), 49)"

    counts = {
        "quality_gauge": f"({found['chart_gauge']})",
        "quality_dimensions": f"({found['chart_dimensions']})",
        "missing_values": f"({found['chart_missing']})",
        "outliers": f"({found['chart_box']})",
        "class_balance": "(SELECT unnest(range(n_unique)) FROM (FROM imbalance ORDER BY is_target DESC, ratio DESC, position LIMIT 1))",
        "feature_importance": "(SELECT col FROM facts WHERE col <> (SELECT col FROM targets ORDER BY score DESC, position LIMIT 1))",
        "correlation_pairs": "(" + union([f"SELECT 1 FROM cleaned HAVING round(corr({a}, {b}), 4) <> 0" for a, b in combinations(nums, 2)]) + ")",
        "distributions": f"(SELECT bin, c FROM range(30) t(bin), unnest({nums}) u(c))",
        "dist": "range(30)",
        "comp": "(SELECT DISTINCT o_orderstatus FROM cleaned)",
        "rel": f'(SELECT DISTINCT x, y, o_orderstatus FROM (SELECT {scaled(nums[0])} AS x, {scaled(nums[1])} AS y, o_orderstatus FROM cleaned))',
        "heat": f"(SELECT a, b FROM unnest({nums}) t(a), unnest({nums}) u(b))",
        "bar": "(SELECT DISTINCT o_orderstatus FROM cleaned)",
        "time_series": f"(SELECT DISTINCT date_trunc('day', o_orderdate), n FROM cleaned, unnest({nums}) u(n))",
    }
    parts = [f"SELECT '{name}' AS chart, count(*) AS n_rows FROM {source}" for name, source in counts.items()]
    return with_(DIRTY, union(parts), clean_ctes(), facts(DIRTY), targets(), imbalance())


def oracle_sql() -> dict[str, str]:
    found = {
        **clean_oracles(),
        **schema_oracles(),
        **quality_oracles(),
        **stats_oracles(),
        **chart_oracles(),
        **context_oracles(),
    }
    return {**found, "dashboard_charts": dashboard(found)}
