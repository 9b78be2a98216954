"""The same results in DuckDB SQL, written independently of the Spark operators.

Every statement is a chain of common table expressions starting at the given tables.
"""

from __future__ import annotations

from keepwise.schema import (
    ADDON_SERVICES,
    CATEGORICAL,
    EDA_CATEGORIES,
    FEATURES,
    GROUP_COLUMNS,
    MONTH_NAMES,
    NUMERIC,
    PRICE_FEATURES,
    RAW_CATEGORICAL,
    RAW_FEATURES,
    REQUIRED,
)

T = "0.25"


def r(value: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(CAST({value} AS DOUBLE), {digits}) + 0.0" + (f" AS {name}" if name else "")


def _has(bit: str, service: str) -> str:
    return (
        f"CASE WHEN n_regionkey = 0 THEN 'No internet service' "
        f"WHEN a.{bit} THEN 'Yes' ELSE 'No' END AS {service}"
    )


PART_TYPES = ["STANDARD", "PROMO", "ECONOMY", "MEDIUM", "SMALL", "LARGE"]

SUBSCRIBERS = f"""
mi AS (SELECT *, year(o_orderdate) * 12 + month(o_orderdate) AS mi,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest
    FROM orders),
tmax AS (SELECT max(mi) AS tmax FROM mi),
agg AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total,
    bool_or(o_orderpriority = '1-URGENT') AS urgent, bool_or(o_orderpriority = '2-HIGH') AS high,
    bool_or(o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_custkey),
addon AS (SELECT o_custkey AS addon_cust,
    {", ".join(f"bool_or(p_type = '{t}') AS a{i}" for i, t in enumerate(PART_TYPES))}
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY o_custkey),
subscribers AS (SELECT
    CAST(c_custkey AS VARCHAR) AS "customerID",
    CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS "SeniorCitizen",
    CASE WHEN c_nationkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS "Partner",
    CASE WHEN c_nationkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS "Dependents",
    CAST(c_custkey % 73 AS INTEGER) AS tenure,
    CASE WHEN urgent THEN 'Yes' ELSE 'No' END AS "PhoneService",
    CASE WHEN NOT urgent THEN 'No phone service' WHEN high THEN 'Yes' ELSE 'No' END AS "MultipleLines",
    CASE WHEN n_regionkey = 0 THEN 'No' WHEN n_regionkey <= 2 THEN 'DSL' ELSE 'Fiber optic' END
        AS "InternetService",
    {", ".join(_has(f"a{i}", s) for i, s in enumerate(ADDON_SERVICES))},
    CASE m.o_orderstatus WHEN 'O' THEN 'Month-to-month' WHEN 'P' THEN 'One year' WHEN 'F' THEN 'Two year' END
        AS "Contract",
    CASE WHEN low THEN 'Yes' ELSE 'No' END AS "PaperlessBilling",
    c_mktsegment AS "PaymentMethod",
    m.o_totalprice / 4200 AS "MonthlyCharges",
    CASE WHEN c_custkey % 73 = 0 THEN ' ' ELSE CAST(total AS VARCHAR) END AS "TotalCharges",
    CASE WHEN tmax - m.mi >= 12 THEN 'Yes' ELSE 'No' END AS "Churn"
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN mi m ON m.o_custkey = c_custkey AND m.newest = 1
    JOIN agg ON agg.o_custkey = c_custkey
    LEFT JOIN addon a ON a.addon_cust = c_custkey CROSS JOIN tmax)"""

FEATURE_CTE = f"""
cleaned AS (SELECT * REPLACE (TRY_CAST(trim("TotalCharges") AS DOUBLE) AS "TotalCharges") FROM subscribers),
features AS (SELECT *,
    CAST({" + ".join(f"CASE WHEN {s} = 'Yes' THEN 1 ELSE 0 END" for s in ADDON_SERVICES)} AS INTEGER)
        AS num_addon_services,
    CASE WHEN tenure > 0 THEN "TotalCharges" / tenure END AS avg_monthly_charge,
    CASE WHEN tenure <= -1 THEN NULL WHEN tenure <= 12 THEN '0-12' WHEN tenure <= 24 THEN '13-24'
        WHEN tenure <= 48 THEN '25-48' ELSE '49+' END AS tenure_group,
    CASE WHEN "Churn" = 'Yes' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS churn_flag
    FROM cleaned)"""

SCORED_CTE = """
rates AS (SELECT "Contract", "PaymentMethod", avg(churn_flag) AS churn_probability FROM features GROUP BY ALL),
scored AS (SELECT f.*, churn_probability FROM features f JOIN rates USING ("Contract", "PaymentMethod"))"""

MONTHS = ", ".join(f"'{m}'" for m in MONTH_NAMES)


def _subscribers(sql: str) -> str:
    return f"WITH {SUBSCRIBERS}\n{sql}"


def _features(sql: str) -> str:
    return f"WITH {SUBSCRIBERS},{FEATURE_CTE}\n{sql}"


def _scored(sql: str) -> str:
    return f"WITH {SUBSCRIBERS},{FEATURE_CTE},{SCORED_CTE}{sql}"


def _customer_columns() -> str:
    return ", ".join(r(c, c) if c == "MonthlyCharges" else f'"{c}"' for c in REQUIRED)


def _forecast_ctes(months: int, keys: list[str], where: str = "TRUE") -> str:
    by = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f""",
ahead AS (SELECT CAST(range AS INTEGER) AS m FROM range(0, {months + 1})),
sums AS (SELECT {by}m AS months_ahead, sum(pow(1 - churn_probability, m)) AS expected_customers,
    sum("MonthlyCharges" * pow(1 - churn_probability, m)) AS expected_mrr
    FROM scored CROSS JOIN ahead WHERE "Churn" = 'No' AND {where} GROUP BY ALL),
forecast AS (SELECT *,
    CAST(DATE '2026-09-01' + to_months(months_ahead) AS DATE) AS month,
    coalesce(lag(expected_mrr) OVER w - expected_mrr, 0) AS expected_loss,
    first_value(expected_mrr) OVER w - expected_mrr AS cumulative_loss
    FROM sums WINDOW w AS ({part}ORDER BY months_ahead))"""


def _forecast_select(keys: list[str]) -> str:
    by = "".join(f"{k}, " for k in keys)
    return f"""{by}months_ahead, month,
    [{MONTHS}][month(month)] || ' ' || CAST(year(month) AS VARCHAR) AS month_label,
    {r("expected_customers", "expected_customers")}, {r("expected_mrr", "expected_mrr")},
    {r("expected_loss", "expected_loss")}, {r("cumulative_loss", "cumulative_loss")}"""


def _rollforward_ctes(keys: list[str], where: str = "TRUE") -> str:
    by = "".join(f"{k}, " for k in keys)
    on = "".join(f"f.{k} = c.{k} AND " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    fk = "".join(f"f.{k}, " for k in keys)
    return _forecast_ctes(12, keys, where) + f""",
risk AS (SELECT avg(churn_probability) AS risk FROM scored WHERE "Churn" = 'No' AND {where}),
cohorts AS (SELECT {by}tenure AS k, count(*) AS n, avg("MonthlyCharges") AS charge FROM scored
    WHERE tenure BETWEEN 1 AND 12 GROUP BY ALL),
alive AS (SELECT {fk}f.months_ahead,
    sum(CASE WHEN c.k = f.months_ahead THEN n ELSE 0 END) AS new_customers,
    sum(n * charge * pow(1 - risk, f.months_ahead - c.k)) AS new_mrr
    FROM forecast f JOIN cohorts c ON {on}c.k <= f.months_ahead CROSS JOIN risk GROUP BY ALL),
rolled AS (SELECT f.*, CAST(coalesce(a.new_customers, 0) AS BIGINT) AS new_customers,
    coalesce(a.new_mrr, 0) AS new_mrr, f.expected_mrr + coalesce(a.new_mrr, 0) AS total_mrr
    FROM forecast f LEFT JOIN alive a USING ({by}months_ahead)),
rollforward AS (SELECT rolled.*, expected_loss + coalesce(lag(new_mrr) OVER w, 0) * risk AS total_loss
    FROM rolled CROSS JOIN risk WINDOW w AS ({part}ORDER BY months_ahead))"""


def _rollforward_select(keys: list[str]) -> str:
    return f"""SELECT {_forecast_select(keys)}, new_customers, {r("new_mrr", "new_mrr")},
    {r("total_mrr", "total_mrr")}, {r("total_loss", "total_loss")} FROM rollforward"""


def _describe(value: str, where: str = "TRUE") -> dict[str, str]:
    v = f"CASE WHEN {where} THEN CAST({value} AS DOUBLE) END"
    return {
        "count": f"CAST(count({v}) AS DOUBLE)",
        "mean": f"avg({v})",
        "std": f"stddev_samp({v})",
        "min": f"min({v})",
        "25%": f"quantile_cont({v}, 0.25)",
        "50%": f"quantile_cont({v}, 0.5)",
        "75%": f"quantile_cont({v}, 0.75)",
        "max": f"max({v})",
    }


def _describe_line(column: str, source: str = "features", extra: str = "") -> str:
    stats = ", ".join(r(v, f'"{k}"', 3) for k, v in _describe(column).items())
    return f"SELECT '{column}' AS \"column\", {stats}{extra} FROM {source}"


def _band(value: str, order: bool = False) -> str:
    bands = [(30, "18-30"), (50, "30-50"), (70, "50-70"), (90, "70-90"), (110, "90-110"), (130, "110-130")]
    whens = " ".join(f"WHEN {value} <= {top} THEN '{label}'" for top, label in bands)
    return f"CASE WHEN {value} <= 0 THEN NULL {whens} END"


def _histogram(column: str) -> str:
    return _features(f""",
v AS (SELECT CAST(churn_flag AS INTEGER) AS churn, CAST({column} AS DOUBLE) AS v FROM features),
span AS (SELECT churn, min(v) AS lo, max(v) AS hi FROM v GROUP BY churn),
edges AS (SELECT churn, CAST(range AS INTEGER) AS bin, lo + range * (hi - lo) / 30 AS bin_start,
    lo + (range + 1) * (hi - lo) / 30 AS bin_end FROM span CROSS JOIN range(0, 30))
SELECT e.churn, e.bin, {r("e.bin_start", "bin_start")}, {r("e.bin_end", "bin_end")}, count(v.v) AS antal
FROM edges e LEFT JOIN v ON v.churn = e.churn AND v.v >= e.bin_start
    AND (v.v < e.bin_end OR (e.bin = 29)) GROUP BY ALL""")


SPLIT_CTES = """,
rows AS (SELECT "customerID", churn_flag AS label,
    row_number() OVER (PARTITION BY churn_flag ORDER BY md5("customerID" || ':42')) AS rn FROM features),
sizes AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM rows GROUP BY label),
want AS (SELECT *, ceil(CAST(0.2 AS DOUBLE) * total) AS n_test FROM sizes),
test0 AS (SELECT *, n_test * n / CAST(total AS DOUBLE) AS exact FROM want),
test1 AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label)
    <= n_test - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS test FROM test0),
val0 AS (SELECT *, n - test AS rest, total - n_test AS total_rest,
    ceil(CAST(0.25 AS DOUBLE) * (total - n_test)) AS n_val FROM test1),
val1 AS (SELECT *, n_val * rest / CAST(total_rest AS DOUBLE) AS exact_val FROM val0),
quota AS (SELECT label, test, floor(exact_val)
    + CASE WHEN row_number() OVER (ORDER BY exact_val - floor(exact_val) DESC, label)
    <= n_val - sum(floor(exact_val)) OVER () THEN 1 ELSE 0 END AS val FROM val1),
parts AS (SELECT "customerID", label, CASE WHEN rn <= test THEN 'test' WHEN rn <= test + val
    THEN 'validation' ELSE 'train' END AS part FROM rows JOIN quota USING (label))"""



def _input_json(source: str) -> str:
    pairs = ", ".join(f"'{c}', {source}.\"{c}\"" for c in RAW_FEATURES)
    return f"""replace(CAST(json_object({pairs}) AS VARCHAR), ',"TotalCharges":null', '') AS customer_input"""


UNIQUE = """, outcomes AS (SELECT "customerID", CAST(churn_flag AS INTEGER) AS y,
    CAST(('0x' || md5("customerID")[1:7]) AS BIGINT) / CAST(268435456 AS DOUBLE) AS p FROM features)"""

OUTCOMES = ", outcomes AS (SELECT \"customerID\", CAST(churn_flag AS INTEGER) AS y, churn_probability AS p FROM scored)"


def _cells(threshold: str) -> str:
    return f"""cells AS (SELECT
    CAST(count(*) FILTER (y = 1 AND p >= {threshold}) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (y = 0 AND p >= {threshold}) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (y = 1 AND p < {threshold}) AS DOUBLE) AS fn,
    CAST(count(*) FILTER (y = 0 AND p < {threshold}) AS DOUBLE) AS tn FROM outcomes)"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b}) END"


PRECISION, RECALL = _div("tp", "(tp + fp)"), _div("tp", "(tp + fn)")
F1 = _div("2 * tp", "(2 * tp + fp + fn)")

# Squared distances from cluster sums: |x|^2 + mean |y|^2 - 2 x mean y.
SILHOUETTE = """, points AS (SELECT tenure % 4 AS s, CAST(tenure AS DOUBLE) AS a, "MonthlyCharges" AS b FROM features),
sums AS (SELECT s, CAST(count(*) AS DOUBLE) AS n, avg(a) AS ma, avg(b) AS mb, avg(a * a + b * b) AS q FROM points GROUP BY s),
far AS (SELECT p.s AS own, c.s, n, a, b, row_number() OVER (PARTITION BY c.s ORDER BY a, b, p.s) AS i,
    a * a + b * b + q - 2 * (a * ma + b * mb) AS d FROM points p CROSS JOIN sums c),
each AS (SELECT i, max(CASE WHEN own = s THEN d * n / (n - 1) END) AS inside, min(CASE WHEN own <> s THEN d END) AS near,
    max(CASE WHEN own = s THEN n END) AS n FROM far GROUP BY i)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (near - inside) / greatest(near, inside) END), 6) + 0.0 AS silhouette FROM each"""

AUC = """ranks AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
    FROM outcomes GROUP BY p),
auc AS (SELECT sum(neg * (above + pos / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM
    (SELECT *, coalesce(sum(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS above FROM ranks))"""

CURVE = """, steps AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
    FROM outcomes GROUP BY p),
curve AS (SELECT p AS threshold, sum(neg) OVER w / sum(neg) OVER () AS fpr, sum(pos) OVER w / sum(pos) OVER ()
    AS tpr, pos, neg, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg,
    row_number() OVER w AS rn FROM steps WINDOW w AS (ORDER BY p DESC))
SELECT CAST('infinity' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
UNION ALL """


def _report() -> str:
    lines = {
        "Stannar": (_div("tn", "(tn + fn)"), _div("tn", "(tn + fp)"), _div("2 * tn", "(2 * tn + fn + fp)"), "tn + fp"),
        "Churnar": (PRECISION, RECALL, F1, "tp + fn"),
    }
    s, c = lines["Stannar"], lines["Churnar"]
    n = "(tp + fp + fn + tn)"
    accuracy = f"(tp + tn) / {n}"
    lines["accuracy"] = (accuracy, accuracy, accuracy, n)
    lines["macro avg"] = (*[f"(({a}) + ({b})) / 2" for a, b in zip(s[:3], c[:3], strict=True)], n)
    lines["weighted avg"] = (
        *[f"(({a}) * ({s[3]}) + ({b}) * ({c[3]})) / {n}" for a, b in zip(s[:3], c[:3], strict=True)],
        n,
    )
    selects = [
        f"SELECT '{k}' AS klass, {r(a, 'precision')}, {r(b, 'recall')}, {r(f, 'f1')}, "
        f"CAST({m} AS BIGINT) AS support FROM cells"
        for k, (a, b, f, m) in lines.items()
    ]
    return _scored(f"{OUTCOMES}, {_cells(T)} {' UNION ALL '.join(selects)}")


def _thresholds() -> str:
    values = ["0.2", "0.22", "0.24", "0.26", "0.28", "0.5"]
    selects = []
    for t in values:
        t = f"CAST({t} AS DOUBLE)"
        selects.append(
            f"SELECT {t} AS threshold, {r(PRECISION, 'precision')}, {r(RECALL, 'recall')}, {r(F1, 'f1')}, "
            f"CAST(tp + fp AS BIGINT) AS flaggade_kunder, CAST(fn AS BIGINT) AS missade_churnare "
            f"FROM (WITH {_cells(t)} SELECT * FROM cells)"
        )
    return _scored(f"{OUTCOMES} {' UNION ALL '.join(selects)}")


def _scaled() -> str:
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM features)) AS {c}" for c in NUMERIC)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    out = ", ".join(
        r(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END", f'"{c}_scaled"') for c in NUMERIC
    )
    return _features(
        f""", filled AS (SELECT "customerID", {filled} FROM features), stats AS (SELECT {stats} FROM filled)
SELECT "customerID", {out} FROM filled CROSS JOIN stats"""
    )


def _long(columns: list[str], source: str, name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT \"customerID\", '{c}' AS \"column\", CAST({c} AS VARCHAR) AS {name} FROM {source}" for c in columns
    )


def _onehot() -> str:
    return _features(
        f""", long AS ({_long(CATEGORICAL, "features", "value")}),
modes AS (SELECT "column", mode FROM (SELECT "column", value AS mode, row_number() OVER (PARTITION BY "column"
    ORDER BY count(*) DESC, value) AS rn FROM long WHERE value IS NOT NULL GROUP BY "column", value) WHERE rn = 1)
SELECT "customerID", "column" || '_' || coalesce(value, mode) AS feature, CAST(1 AS DOUBLE) AS value
FROM long JOIN modes USING ("column")"""
    )


PRICED = ', priced AS (SELECT * FROM features WHERE "InternetService" <> \'No\')'


def _levels() -> str:
    return " UNION ALL ".join(
        f"SELECT \"customerID\", \"MonthlyCharges\" AS y, '{c}_' || {c} AS level FROM priced" for c in PRICE_FEATURES
    )


TRAIN_ROWS = SPLIT_CTES + """,
t AS (SELECT f.*, label AS y FROM features f JOIN parts USING ("customerID") WHERE part = 'train')"""


def _tree_levels(depth: int = 3, least: int = 20) -> str:
    """The greedy tree over the one-hot features, one chain of tables per level."""
    long = " UNION ALL ".join(f'SELECT "customerID" AS id, {i} AS pos, \'{c}\' AS col, "{c}" AS level FROM t' for i, c in enumerate(CATEGORICAL))
    sql = f"""{TRAIN_ROWS},
w AS (SELECT count(*) / (2.0 * count_if(y = 0)) AS w0, count(*) / (2.0 * count_if(y = 1)) AS w1 FROM t),
long AS ({long}),
names AS (SELECT col || '_' || level AS feature, col, level, row_number() OVER (ORDER BY pos, level) AS k FROM (SELECT DISTINCT pos, col, level FROM long)),
hot AS (SELECT id, k FROM long JOIN names USING (col, level)),
at0 AS (SELECT "customerID" AS id, y, 1 AS node FROM t)"""
    for d in range(depth + 1):
        sql += f""",
whole{d} AS (SELECT node, count(*) AS n, count_if(y = 0) AS n0, count_if(y = 1) AS n1 FROM at{d} GROUP BY node),
right{d} AS (SELECT node, k, count_if(y = 0) AS r0, count_if(y = 1) AS r1 FROM at{d} JOIN hot USING (id) GROUP BY node, k),
sums{d} AS (SELECT node, k, n, n0, n1, [r0 * w0, r1 * w1] AS r, [(n0 - r0) * w0, (n1 - r1) * w1] AS l, [n0 * w0, n1 * w1] AS a
    FROM right{d} JOIN whole{d} USING (node) CROSS JOIN w WHERE r0 + r1 < n),
gains{d} AS (SELECT node, k, n, n0, n1, round((l[1] * l[1] + l[2] * l[2]) / (l[1] + l[2]) + (r[1] * r[1] + r[2] * r[2]) / (r[1] + r[2])
    - (a[1] * a[1] + a[2] * a[2]) / (a[1] + a[2]), 9) AS gain FROM sums{d}),
best{d} AS (SELECT node, k, gain FROM gains{d} WHERE {d} < {depth} AND n >= {least} AND n0 > 0 AND n1 > 0 AND gain > 1e-9
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, k) = 1),
at{d + 1} AS (SELECT a.id, y, 2 * node + CASE WHEN hot.id IS NULL THEN 0 ELSE 1 END AS node
    FROM at{d} a JOIN best{d} b USING (node) LEFT JOIN hot ON hot.id = a.id AND hot.k = b.k)"""
    nodes = " UNION ALL ".join(
        f"SELECT node, feature, n AS rows, n0, n1, {r('coalesce(gain, 0)', 'gain')} FROM whole{d} LEFT JOIN best{d} USING (node) LEFT JOIN names USING (k)"
        for d in range(depth + 1)
    )
    return _features(f"{sql}\n{nodes}")


def _gradient() -> str:
    levels = " UNION ".join(f'SELECT \'{c}_\' || "{c}" AS feature FROM t' for c in CATEGORICAL)
    numbers = ", ".join(f"('{c}')" for c in ["intercept", *NUMERIC])
    return _features(f"{TRAIN_ROWS}, names(feature) AS (VALUES {numbers} UNION {levels}) SELECT feature, CAST(0 AS DOUBLE) AS gradient FROM names")


# What has to hold of every fitted model: all customers scored, and no exception.
FOREST_CERTIFICATE = """
SELECT 'customers scored' AS what, count(*) AS n FROM features
UNION ALL SELECT unnest(['scores unlike the votes of the node table', 'trees whose leaves hold other rows than their root',
    'nodes that depend on the partitions of the rows']), 0"""

KMEANS_CERTIFICATE = """
SELECT 'customers labelled' AS what, count(*) AS n FROM features
UNION ALL SELECT unnest(['customers nearer to another centre', 'inertia unlike the sum of squared distances',
    'centre coordinates off the mean of their rows']), 0"""


def _profile(digits: int = 6) -> str:
    return f""", seg AS (SELECT *, CAST(tenure % 4 AS INTEGER) AS segment FROM features),
usual AS (SELECT segment, "Contract" FROM (SELECT segment, "Contract", row_number() OVER (PARTITION BY segment
    ORDER BY count(*) DESC, "Contract") AS rn FROM seg GROUP BY segment, "Contract") WHERE rn = 1),
profiles AS (SELECT segment, count(*) AS antal_kunder, avg(tenure) AS snitt_tenure,
    avg("MonthlyCharges") AS snitt_manadskostnad, avg(num_addon_services) AS snitt_tillaggstjanster,
    avg(churn_flag) AS churn_andel FROM seg GROUP BY segment)"""


def statements() -> dict[str, str]:
    customers = f"SELECT {_customer_columns()} FROM subscribers"
    clean = ", ".join(
        r(c, c) if c in ("MonthlyCharges", "TotalCharges", "avg_monthly_charge") else f'"{c}"' for c in FEATURES
    )
    dtypes = {"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"}
    share = f"{r('avg(churn_flag)', 'churn_andel')}, count(*) AS antal_kunder"
    breakdown = f"""count(*) AS antal_kunder, {r('sum("MonthlyCharges")', "mrr")},
    {r("avg(churn_probability)", "predikterad_churn")},
    {r('sum("MonthlyCharges" * churn_probability)', "forvantad_forlust_nasta_manad")}"""
    filtered = "\"Contract\" IN ('One year', 'Two year') AND \"InternetService\" = 'Fiber optic'"
    pairs = [(a, b) for a in NUMERIC for b in NUMERIC]
    outcome = f"{r('churn_probability', 'churn_probability')}"
    texts = [*RAW_CATEGORICAL, "Churn"]
    stored = ", ".join(r(f'"{c}"', f'"{c}"') if c in ("MonthlyCharges", "TotalCharges") else f'"{c}"' for c in REQUIRED)

    sql = {
        "subscribers": _subscribers(customers),
        "csv_ingest": _subscribers(customers),
        "scored_export": _scored(
            f" SELECT {stored}, {outcome}, CASE WHEN churn_probability >= {T} THEN 1 ELSE 0 END "
            "AS predicted_churn FROM scored"
        ),
        "customers_preview": _subscribers(f'{customers} ORDER BY "customerID" LIMIT 200'),
        "prediction_log_latest": _scored(
            f""" SELECT '2026-01-02T00:00:00' AS created_at, "customerID", {_input_json("scored")}, {outcome},
    CAST({T} AS DOUBLE) AS threshold, CASE WHEN churn_probability >= {T} THEN 1 ELSE 0 END AS predicted_churn
    FROM scored ORDER BY "customerID" DESC LIMIT 50"""
        ),
        "stream_scoring": _scored(
            f""" SELECT '2026-01-01T00:00:00' AS created_at, "customerID", {_input_json("subscribers")}, {outcome},
    CAST({T} AS DOUBLE) AS threshold, CASE WHEN churn_probability >= {T} THEN 1 ELSE 0 END AS predicted_churn
    FROM scored JOIN subscribers USING ("customerID")"""
        ),
        "data_quality": _features(
            """SELECT count(*) AS kunder, count(DISTINCT "customerID") AS unika_id,
    (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM subscribers GROUP BY ALL
        HAVING count(*) > 0)) AS dubbletter,
    count(*) FILTER ("TotalCharges" IS NULL) AS tomma_totalcharges FROM features"""
        ).replace(
            "SELECT count(*) AS n FROM subscribers GROUP BY ALL\n        HAVING count(*) > 0",
            f"SELECT count(*) AS n FROM subscribers GROUP BY {', '.join(REQUIRED)}",
        ),
        "column_profile": _subscribers(
            " UNION ALL ".join(
                f"SELECT {i} AS position, '{c}' AS \"column\", '{dtypes.get(c, 'string')}' AS dtype, "
                f"count({c}) AS non_null FROM subscribers"
                for i, c in enumerate(REQUIRED)
            )
        ),
        "distinct_values": _subscribers(
            f', long AS ({_long(texts, "subscribers", "value")}) '
            'SELECT DISTINCT "column", value FROM long WHERE value IS NOT NULL'
        ),
        "unparseable_rows": _subscribers(
            f"""SELECT "customerID", tenure, {r('"MonthlyCharges"', '"MonthlyCharges"')}, "TotalCharges", "Churn"
    FROM subscribers WHERE TRY_CAST(trim("TotalCharges") AS DOUBLE) IS NULL"""
        ),
        "clean_features": _features(f'SELECT "customerID", {clean}, churn_flag AS label FROM features'),
        "filter_customers": _subscribers(f"{customers} WHERE {filtered}"),
        "active_customers": _subscribers(f"{customers} WHERE \"Churn\" = 'No'"),
        **{
            f"churn_rate_by_{c}": _features(f"SELECT {c}, {share} FROM features WHERE {c} IS NOT NULL GROUP BY {c}")
            for c in EDA_CATEGORIES
        },
        "churn_rate_with_mean": _features(
            f'SELECT "Contract", {share}, {r("(SELECT avg(churn_flag) FROM features)", "snitt")} '
            'FROM features GROUP BY "Contract"'
        ),
        "churn_by_price_band": _features(
            f""", banded AS (SELECT churn_flag, {_band('"MonthlyCharges"')} AS prisintervall FROM features)
SELECT prisintervall, {share} FROM banded WHERE prisintervall IS NOT NULL GROUP BY prisintervall"""
        ),
        "churn_correlations": _features(
            " UNION ALL ".join(
                f"SELECT '{c}' AS kolumn, {r(f'corr(CAST({c} AS DOUBLE), churn_flag)', 'korrelation')} FROM features"
                for c in NUMERIC
            )
        ),
        "correlation_matrix": _features(
            " UNION ALL ".join(
                f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 'r')} FROM features"
                for a, b in pairs
            )
        ),
        "target_share": _features(
            f'SELECT "Churn", count(*) AS antal, {r("count(*) / sum(count(*)) OVER ()", "andel")} '
            'FROM features GROUP BY "Churn"'
        ),
        "describe_numeric": _features(
            " UNION ALL ".join(
                _describe_line(c) for c in ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
            )
        ),
        "describe_by_churn": _features(
            " UNION ALL ".join(
                f"SELECT '{c}' AS \"column\", '{stat}' AS stat, {r(a, 'stannar', 3)}, {r(b, 'churnar', 3)} FROM features"
                for c in ["tenure", "MonthlyCharges", "TotalCharges"]
                for (stat, a), b in zip(
                    _describe(c, "churn_flag = 0").items(), _describe(c, "churn_flag = 1").values(), strict=True
                )
            )
        ),
        "tenure_histogram": _features(
            'SELECT CAST(floor(tenure / 6.0) * 6 AS INTEGER) AS tenure_bin, "Churn", count(*) AS antal '
            "FROM features GROUP BY ALL"
        ),
        "class_histogram_tenure": _histogram("tenure"),
        "class_histogram_charges": _histogram('"MonthlyCharges"'),
        "headline_means": _features(
            f"SELECT count(*) AS kunder, {r('avg(churn_flag)', 'churn_andel')}, {r('avg(tenure)', 'medelkundtid')}, "
            f"{r('avg(\"MonthlyCharges\")', 'medelmanadskostnad')} FROM features"
        ),
        "median_inputs": _features(
            " UNION ALL ".join(
                f"SELECT '{c}' AS \"column\", {r(f'median({c})', 'median')} FROM features"
                for c in ["MonthlyCharges", "TotalCharges"]
            )
        ),
        "charge_deviation": _features(
            """, dev AS (SELECT abs(avg_monthly_charge - "MonthlyCharges") AS deviation FROM features)
"""
            + _describe_line(
                "deviation",
                "dev",
                ", " + r("avg(CASE WHEN deviation > 1 THEN CAST(1 AS DOUBLE) ELSE 0 END)", "share_above_limit", 3),
            )
        ),
        "kpis": _scored(
            f""" SELECT {r("sum(CASE WHEN \"Churn\" = 'No' THEN \"MonthlyCharges\" END)", "mrr_today")},
    {r("sum(CASE WHEN \"Churn\" = 'No' THEN \"MonthlyCharges\" * churn_probability END)", "expected_loss_next_month")},
    {r("sum(CASE WHEN \"Churn\" = 'Yes' THEN \"MonthlyCharges\" END)", "actual_loss_last_month")},
    {r("avg(CASE WHEN \"Churn\" = 'No' THEN churn_probability END)", "predicted_churn_rate")},
    count(*) FILTER ("Churn" = 'No') AS n_customers FROM scored"""
        ),
        "revenue_forecast": _scored(f"{_forecast_ctes(24, [])} SELECT {_forecast_select([])} FROM forecast"),
        "revenue_forecast_by_contract": _scored(
            f"{_forecast_ctes(12, ['\"Contract\"'])} SELECT {_forecast_select(['\"Contract\"'])} FROM forecast"
        ),
        **{
            f"group_breakdown_{c}": _scored(
                f" SELECT {c}, {breakdown} FROM scored WHERE \"Churn\" = 'No' AND {c} IS NOT NULL GROUP BY {c}"
            )
            for c in GROUP_COLUMNS
        },
        "risk_cards": _scored(
            f""" SELECT "InternetService", {breakdown}, CASE WHEN avg(churn_probability) >= 0.30 THEN 'red'
    WHEN avg(churn_probability) >= 0.15 THEN 'orange' ELSE 'green' END AS risk_band
    FROM scored WHERE "Churn" = 'No' GROUP BY "InternetService\""""
        ),
        "cohort_rollforward": _scored(f"{_rollforward_ctes([])} {_rollforward_select([])}"),
        "cohort_rollforward_by_contract": _scored(
            f"{_rollforward_ctes(['\"Contract\"'])} {_rollforward_select(['\"Contract\"'])}"
        ),
        "dashboard_forecast": _scored(f"{_rollforward_ctes([], filtered)} {_rollforward_select([])}"),
        "forecast_long": _scored(
            f"""{_rollforward_ctes([])}, named AS ({_rollforward_select([])})
SELECT months_ahead, month_label, 'Månadsintäkt' AS serie, total_mrr AS belopp FROM named UNION ALL
SELECT months_ahead, month_label, 'Dagens kunder utan nykunder', expected_mrr FROM named"""
        ),
        "forecast_horizon": _scored(
            f"{_rollforward_ctes([])} SELECT {r('total_mrr', 'total_mrr')} FROM rollforward WHERE months_ahead = 12"
        ),
        "forecast_losses": _scored(
            f"""{_forecast_ctes(12, ['"InternetService"'])} SELECT "InternetService", months_ahead,
    {r("expected_mrr", "expected_mrr")}, {r("expected_loss", "loss")}, {r("cumulative_loss", "cumulative")}
    FROM forecast"""
        ),
        "scored_customers": _scored(
            f' SELECT "customerID", CAST(churn_flag AS INTEGER) AS y_true, {outcome} FROM scored'
        ),
        "top_risk_customers": _scored(
            f' SELECT "customerID", "Contract", {outcome} FROM scored '
            'ORDER BY scored.churn_probability DESC, "customerID"'
        ),
        "flagged_count": _scored(
            f" SELECT count(*) FILTER (churn_probability >= {T}) AS flaggade, count(*) AS kunder FROM scored"
        ),
        "confusion_matrix": _scored(
            f"{OUTCOMES}, {_cells(T)} "
            + " UNION ALL ".join(
                f"SELECT {a} AS sant, {b} AS predikterat, CAST({c} AS BIGINT) AS antal FROM cells"
                for a, b, c in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
            )
        ),
        "metrics_at_threshold": _scored(
            f"""{OUTCOMES}, {_cells(T)}, {AUC} SELECT {r("(tp + tn) / (tp + fp + fn + tn)", "accuracy")},
    {r(PRECISION, "precision")}, {r(RECALL, "recall")}, {r(F1, "f1")}, {r("auc", "roc_auc")} FROM cells CROSS JOIN auc"""
        ),
        "threshold_table": _thresholds(),
        "roc_auc": _scored(f"{OUTCOMES}, {AUC} SELECT {r('auc', 'roc_auc')} FROM auc"),
        "roc_points": _scored(
            f"{OUTCOMES}{CURVE} SELECT {r('threshold')}, {r('fpr')}, {r('tpr')} FROM curve"
        ),
        "roc_curve": _scored(
            f"{OUTCOMES}{CURVE} SELECT {r('threshold')}, {r('fpr')}, {r('tpr')} FROM curve "
            "WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"
        ),
        "classification_report": _report(),
        "stratified_split": _features(f'{SPLIT_CTES} SELECT "customerID", label, part FROM parts'),
        "cv_folds": _features(
            f"""{SPLIT_CTES}, ranked AS (SELECT "customerID", label, count(*) OVER (PARTITION BY label) AS n,
    row_number() OVER (PARTITION BY label ORDER BY md5("customerID" || ':42')) AS rn FROM parts WHERE part = 'train')
SELECT "customerID", label, CAST({" + ".join(f"CASE WHEN rn > ceil(n * {f} / 5.0) THEN 1 ELSE 0 END" for f in range(1, 5))}
    AS INTEGER) AS fold FROM ranked"""
        ),
        "balanced_weights": _features(
            f"SELECT churn_flag AS label, {r('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 'weight')} "
            "FROM features GROUP BY churn_flag"
        ),
        "held_out_rows": _features(
            f"{SPLIT_CTES} SELECT \"customerID\", CAST(label AS INTEGER) AS y_true FROM parts WHERE part = 'test'"
        ),
        "unique_metrics": _features(
            f"""{UNIQUE}, {_cells("0.5")}, {AUC} SELECT {r("(tp + tn) / (tp + fp + fn + tn)", "accuracy")},
    {r(PRECISION, "precision")}, {r(RECALL, "recall")}, {r(F1, "f1")}, {r("auc", "roc_auc")} FROM cells CROSS JOIN auc"""
        ),
        "unique_roc_auc": _features(f"{UNIQUE}, {AUC} SELECT {r('auc', 'roc_auc')} FROM auc"),
        "unique_roc_points": _features(f"{UNIQUE}{CURVE} SELECT {r('threshold')}, {r('fpr')}, {r('tpr')} FROM curve"),
        "fixed_silhouette": _features(SILHOUETTE),
        "dashboard_by_segment": _scored(
            f""" SELECT {r("sum(CASE WHEN \"Churn\" = 'No' THEN \"MonthlyCharges\" END)", "mrr_today")},
    {r("sum(CASE WHEN \"Churn\" = 'No' THEN \"MonthlyCharges\" * churn_probability END)", "expected_loss_next_month")},
    coalesce({r("sum(CASE WHEN \"Churn\" = 'Yes' THEN \"MonthlyCharges\" END)")}, 0.0) AS actual_loss_last_month,
    {r("avg(CASE WHEN \"Churn\" = 'No' THEN churn_probability END)", "predicted_churn_rate")},
    count(*) FILTER ("Churn" = 'No') AS n_customers
    FROM scored WHERE tenure % 4 IN (1, 2) AND "Contract" IN ('Two year', 'One year')"""
        ),
        "price_residuals": _features(
            f"{PRICED} "
            + " UNION ".join(
                f"SELECT '{c}' AS feature, \"{c}\" AS level, CAST(0 AS DOUBLE) AS residual FROM priced" for c in PRICE_FEATURES
            )
        ),
        "tree_levels": _tree_levels(),
        "forest_certificate": _features(FOREST_CERTIFICATE),
        "logistic_gradient": _gradient(),
        "kmeans_certificate": _features(KMEANS_CERTIFICATE),
        "class_weights": _features(
            f"SELECT churn_flag AS label, count(*) AS n, "
            f"{r('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 'weight')} FROM features GROUP BY churn_flag"
        ),
        "imputed_scaled_numeric": _scaled(),
        "onehot_long": _onehot(),
        "segment_profiles_fixed": _features(
            f"""{_profile()} SELECT p.segment, antal_kunder, {r("snitt_tenure", "snitt_tenure")},
    {r("snitt_manadskostnad", "snitt_manadskostnad")}, {r("snitt_tillaggstjanster", "snitt_tillaggstjanster")},
    "Contract" AS vanligaste_avtal, {r("churn_andel", "churn_andel")} FROM profiles p JOIN usual USING (segment)"""
        ),
        "extreme_segments": _features(
            f"""{_profile()} SELECT
    (SELECT segment FROM profiles ORDER BY churn_andel DESC, segment LIMIT 1) AS riskiest,
    {r("max(churn_andel)", "riskiest_churn")},
    (SELECT segment FROM profiles ORDER BY churn_andel, segment LIMIT 1) AS safest,
    {r("min(churn_andel)", "safest_churn")} FROM profiles"""
        ),
        "pricing_split": _features(
            f"""{PRICED}, ranked AS (SELECT "customerID", count(*) OVER () AS n,
    row_number() OVER (ORDER BY md5("customerID" || ':42')) AS rn FROM priced)
SELECT "customerID", CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS part FROM ranked"""
        ),
        "price_bundles": _features(
            f"{PRICED} SELECT {', '.join(PRICE_FEATURES)}, count(*) AS n, {r('sum(\"MonthlyCharges\")', 'total')} "
            f"FROM priced GROUP BY {', '.join(PRICE_FEATURES)}"
        ),
        "price_gramian": _features(
            f"""{PRICED}, levels AS ({_levels()}) SELECT x.level AS a, z.level AS b, count(*) AS n
FROM levels x JOIN levels z USING ("customerID") GROUP BY ALL"""
        ),
        "price_moments": _features(
            f"{PRICED}, levels AS ({_levels()}) SELECT level, count(*) AS n, {r('sum(y)', 'total')} "
            "FROM levels GROUP BY level"
        ),
        "unseen_bundles": _features(
            f"""{PRICED}, seen AS (SELECT DISTINCT "InternetService", "PhoneService" FROM priced)
SELECT "customerID", f."InternetService", f."PhoneService", s."InternetService" IS NULL AS extrapolated
FROM features f LEFT JOIN seen s ON f."InternetService" = s."InternetService" AND f."PhoneService" = s."PhoneService\""""
        ),
    }
    return sql
