"""DuckDB SQL oracles, one per registered query (same column names)."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_ALL = LINEITEM_NUMERIC + ["l_returnflag", "l_linestatus", "l_shipdate"]

DIRTY = """
WITH shaped AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 503 = 0 THEN l_extendedprice * 100
         ELSE l_extendedprice END AS price,
    CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END AS flag,
    CASE WHEN l_orderkey % 10 < 7 THEN NULL ELSE l_tax END AS sparse,
    CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_linestatus END AS target
  FROM lineitem),
dirty AS (SELECT * FROM shaped UNION ALL SELECT * FROM shaped WHERE l_orderkey % 97 = 0)
"""
DIRTY_COLS = ["l_orderkey", "l_linenumber", "price", "flag", "sparse", "target"]


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def oracle(key: str, sql: str) -> None:
    ORACLES[key] = sql


# ── profile ──────────────────────────────────────────────────────────────────

oracle("table_shape", """
SELECT count(*) AS n_rows,
  (SELECT CAST(count(*) AS INTEGER) FROM information_schema.columns
   WHERE table_name = 'lineitem') AS n_cols
FROM lineitem""")

_MISSING = DIRTY + "," + "\nm AS (" + union(
    [f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
     f"count(*) AS n_rows FROM dirty" for c in DIRTY_COLS]) + ")\n"

oracle("missing_report", _MISSING + """
SELECT "column", n_missing, round(CAST(n_missing AS DOUBLE) / n_rows * 100, 2) AS pct
FROM m WHERE n_missing > 0""")

oracle("high_missing_columns", _MISSING + """
SELECT "column", round(CAST(n_missing AS DOUBLE) / n_rows * 100, 2) AS pct
FROM m WHERE round(CAST(n_missing AS DOUBLE) / n_rows * 100, 2) > 50""")

oracle("cardinality", union(
    [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem"
     for c in LINEITEM_ALL]))


def _numeric_stats(table: str, c: str, with_name: bool = True) -> str:
    name = f"'{c}' AS \"column\", " if with_name else ""
    return (f"SELECT {name}round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
            f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, "
            f"round(quantile_cont({c}, 0.5), 4) AS median FROM {table}")


oracle("numeric_stats", union([_numeric_stats("lineitem", c) for c in LINEITEM_NUMERIC]))

oracle("top_values", """
WITH vc AS (""" + union(
    [f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n "
     f"FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2"
     for c in ["l_returnflag", "l_linestatus", "l_shipdate"]]) + """),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rk
      FROM vc)
SELECT "column", value, n, rk FROM r WHERE rk <= 5""")

oracle("correlation_matrix", union(
    [f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
     f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 4) END AS corr "
     f"FROM lineitem" for a in LINEITEM_NUMERIC for b in LINEITEM_NUMERIC]))

oracle("target_numeric_summary", _numeric_stats("orders", "o_totalprice", with_name=False))

oracle("class_balance", DIRTY + """
SELECT target AS class, count(*) AS n,
  round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM dirty) * 100, 2) AS pct
FROM dirty WHERE target IS NOT NULL GROUP BY target""")

oracle("task_type_detect", union(
    [f"SELECT '{c}' AS \"column\", CASE WHEN {'FALSE' if c in LINEITEM_NUMERIC else 'TRUE'} "
     f"OR count(DISTINCT {c}) <= 20 THEN 'classification' ELSE 'regression' END AS task_type "
     f"FROM lineitem" for c in LINEITEM_ALL]))

_WIDTH = {"l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8,
          "l_extendedprice": 8, "l_discount": 8, "l_tax": 8, "l_shipdate": 8}
oracle("payload_bytes", union(
    [f"SELECT '{c}' AS \"column\", CAST(count({c}) * {_WIDTH[c]} AS BIGINT) AS n_bytes FROM lineitem"
     if c in _WIDTH else
     f"SELECT '{c}' AS \"column\", CAST(coalesce(sum(strlen({c})), 0) AS BIGINT) AS n_bytes FROM lineitem"
     for c in LINEITEM_ALL]))


oracle("structure_report", "WITH s AS (" + union(
    [_numeric_stats("lineitem", c) for c in LINEITEM_NUMERIC]) + "), b AS (" + union(
    [f"SELECT '{c}' AS \"column\", "
     f"'{'numeric' if c in LINEITEM_NUMERIC else ('datetime' if c == 'l_shipdate' else 'categorical')}'"
     f" AS label, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
     f"count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in LINEITEM_ALL]) + "), pb AS (" +
    ORACLES["payload_bytes"] + "), tp AS (SELECT \"column\", list(value ORDER BY rk) AS top FROM (" +
    ORACLES["top_values"] + """) GROUP BY 1)
SELECT b."column", label, n_missing, n_distinct, mean, std, min, max, median, n_bytes, top
FROM b LEFT JOIN s ON b."column" = s."column" JOIN pb ON b."column" = pb."column"
LEFT JOIN tp ON b."column" = tp."column"
""")


# ── cleaning ─────────────────────────────────────────────────────────────────

oracle("drop_sparse_columns", DIRTY + "SELECT l_orderkey, l_linenumber, price, flag, target FROM dirty")
oracle("dedup_rows", DIRTY + "SELECT DISTINCT * FROM dirty")
oracle("duplicates_removed", DIRTY + """
SELECT count(*) AS n_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS n_after,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates_removed
FROM dirty""")
oracle("drop_null_target", DIRTY + "SELECT * FROM dirty WHERE target IS NOT NULL")

CLEAN_CHAIN = DIRTY + """,
d1 AS (SELECT DISTINCT l_orderkey, l_linenumber, price, flag, target FROM dirty),
d2 AS (SELECT * FROM d1 WHERE target IS NOT NULL),
med AS (SELECT quantile_cont(price, 0.5) AS m FROM d2),
d3 AS (SELECT l_orderkey, l_linenumber, coalesce(price, (SELECT m FROM med)) AS price, flag, target
       FROM d2),
md AS (SELECT flag FROM d3 WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1),
d4 AS (SELECT l_orderkey, l_linenumber, price, coalesce(flag, (SELECT flag FROM md)) AS flag, target
       FROM d3),
qs AS (""" + union([f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, "
                    f"quantile_cont({c}, 0.75) AS q3 FROM d4"
                    for c in ["l_orderkey", "l_linenumber", "price"]]) + """),
bnd AS (SELECT "column", q1, q3, q3 - q1 AS iqr, q1 - 3.0 * (q3 - q1) AS lower,
               q3 + 3.0 * (q3 - q1) AS upper FROM qs),
cnt AS (""" + union([f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < lower OR {c} > upper) "
                     f"AS n FROM d4, bnd WHERE bnd.\"column\" = '{c}'"
                     for c in ["l_orderkey", "l_linenumber", "price"]]) + """),
pb AS (SELECT lower, upper FROM bnd WHERE "column" = 'price'),
d5 AS (SELECT l_orderkey, l_linenumber,
         CASE WHEN price IS NULL THEN NULL ELSE greatest(least(price, (SELECT upper FROM pb)),
              (SELECT lower FROM pb)) END AS price, flag, target FROM d4)
"""

oracle("impute_median", CLEAN_CHAIN + """
SELECT l_orderkey, l_linenumber, round(price, 4) AS price, flag, target FROM d3""")
oracle("impute_mode", CLEAN_CHAIN + """
SELECT l_orderkey, l_linenumber, round(price, 4) AS price, flag, target FROM d4""")
oracle("quartiles", CLEAN_CHAIN + """
SELECT "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr FROM bnd""")
oracle("outlier_count", CLEAN_CHAIN + """
SELECT cnt."column", n AS n_outliers FROM cnt JOIN bnd ON cnt."column" = bnd."column"
WHERE iqr <> 0""")
_NAN_BOUNDS = DIRTY.rstrip() + """,
q AS (SELECT quantile_cont(l_orderkey, 0.25) AS a1, quantile_cont(l_orderkey, 0.75) AS a3,
             quantile_cont(l_linenumber, 0.25) AS b1, quantile_cont(l_linenumber, 0.75) AS b3,
             quantile_cont(price, 0.25) AS c1, quantile_cont(price, 0.75) AS c3 FROM dirty)
"""
oracle("outliers_with_nan", _NAN_BOUNDS + union(
    [f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < {x}1 - 3 * ({x}3 - {x}1) OR {c} > {x}3 + 3 * ({x}3 - {x}1))"
     f" AS n_outliers FROM dirty, q" for c, x in (("l_orderkey", "a"), ("l_linenumber", "b"), ("price", "c"))]))
oracle("clip_with_nan", _NAN_BOUNDS + """
SELECT l_orderkey, l_linenumber, CASE WHEN price IS NULL THEN NULL ELSE
  round(greatest(least(price, c3 + 3 * (c3 - c1)), c1 - 3 * (c3 - c1)), 4) END AS price FROM dirty, q""")
oracle("iqr_clip", CLEAN_CHAIN + """
SELECT l_orderkey, l_linenumber, round(price, 4) AS price, flag, target FROM d5""")
oracle("clip_bounds", CLEAN_CHAIN + """
SELECT bnd."column", round(lower, 4) AS lower, round(upper, 4) AS upper, n AS n_clipped
FROM bnd JOIN cnt ON bnd."column" = cnt."column" WHERE iqr <> 0 AND n > 0""")
oracle("cleaning_report", CLEAN_CHAIN + """
SELECT (SELECT count(*) FROM dirty) AS rows_before, (SELECT count(*) FROM d5) AS rows_after,
  (SELECT count(*) FROM dirty) - (SELECT count(*) FROM d5) AS rows_dropped,
  (SELECT count(*) FROM dirty) - (SELECT count(*) FROM d1) AS duplicates_removed,
  (SELECT count(*) FROM d1) - (SELECT count(*) FROM d2) AS target_missing_dropped,
  ['sparse'] AS columns_dropped, ['price'] AS columns_imputed_numeric,
  ['flag'] AS columns_imputed_categorical,
  (SELECT list("column" ORDER BY "column") FROM bnd JOIN cnt USING ("column")
   WHERE iqr <> 0 AND n > 0) AS columns_clipped,
  (SELECT list(round(lower, 4) ORDER BY "column") FROM bnd JOIN cnt USING ("column") WHERE iqr <> 0 AND n > 0) AS clip_lower,
  (SELECT list(round(upper, 4) ORDER BY "column") FROM bnd JOIN cnt USING ("column") WHERE iqr <> 0 AND n > 0) AS clip_upper,
  (SELECT list(n ORDER BY "column") FROM bnd JOIN cnt USING ("column") WHERE iqr <> 0 AND n > 0) AS clip_n,
  """ + f"{DIRTY_COLS} AS columns_before, {[c for c in DIRTY_COLS if c != 'sparse']} AS columns_after" + """,
  0.6::DOUBLE AS drop_missing_threshold, 3.0::DOUBLE AS iqr_multiplier, 'median' AS imputation_numeric,
  'mode_or_constant' AS imputation_categorical""")


# ── features ─────────────────────────────────────────────────────────────────

ORDER_FEATURES = """
WITH li AS (SELECT l_orderkey, count(*) AS n_lines, avg(l_discount) AS avg_discount,
                   sum(l_quantity) AS sum_qty FROM lineitem GROUP BY l_orderkey),
of AS (SELECT o_orderkey, o_orderpriority, o_totalprice, c_acctbal, c_mktsegment, n_name, n_lines,
              avg_discount, sum_qty, o_orderstatus
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN li ON l_orderkey = o_orderkey)"""

# The nation table holds NATION_0 … NATION_24 (25 rows at every scale).
NATIONS = sorted(f"NATION_{i}" for i in range(25))
NATION_LEVELS = NATIONS[1:]          # one-hot drops the first level in sorted order


def _codes(cte: str, c: str) -> str:
    return (f"{c}_codes AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS code "
            f"FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan') AS v FROM {cte}))")


def _encoded(target: str) -> tuple[str, list[str]]:
    """SQL for the ordinal + one-hot table ``enc`` and its feature names."""
    ordinal = ["o_orderpriority", "c_mktsegment"] + (["o_orderstatus"] if target != "o_orderstatus"
                                                      else [])
    numeric = [c for c in ["o_totalprice", "c_acctbal", "n_lines", "avg_discount", "sum_qty"]
               if c != target]
    dummies = [f"n_name_{v}" for v in NATION_LEVELS]
    sel = ["of.o_orderkey"]
    sel += [f"{c}_codes.code AS {c}" for c in ordinal]
    sel += [f"CAST(of.{c} AS DOUBLE) AS {c}" for c in numeric]
    sel += [f"CASE WHEN n_name = '{v}' THEN 1.0 ELSE 0.0 END AS n_name_{v}" for v in NATION_LEVELS]
    sel += [f"of.{target}"]
    joins = " ".join(f"JOIN {c}_codes ON {c}_codes.v = coalesce(CAST(of.{c} AS VARCHAR), 'nan')"
                     for c in ordinal)
    sql = (ORDER_FEATURES + ",\n" + ",\n".join(_codes("of", c) for c in ordinal) +
           f",\nenc AS (SELECT {', '.join(sel)} FROM of {joins})")
    return sql, ordinal + numeric + dummies


_ENC_CLS, FEATURES_CLS = _encoded("o_orderstatus")
_ENC_REG, FEATURES_REG = _encoded("o_totalprice")

oracle("ordinal_encode", ORDER_FEATURES + ",\n" + _codes("of", "o_orderpriority") + ",\n" +
       _codes("of", "c_mktsegment") + """
SELECT o_orderkey, a.code AS o_orderpriority, b.code AS c_mktsegment FROM of
JOIN o_orderpriority_codes a ON a.v = coalesce(o_orderpriority, 'nan')
JOIN c_mktsegment_codes b ON b.v = coalesce(c_mktsegment, 'nan')""")

oracle("rare_to_other", """
WITH vc AS (SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name),
top AS (SELECT p_name FROM vc ORDER BY n DESC, p_name LIMIT 50)
SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM top) THEN p_name ELSE '__other__' END
  AS p_name FROM part""")

oracle("one_hot_encode", ORDER_FEATURES + "\nSELECT o_orderkey, " + ", ".join(
    f"CASE WHEN n_name = '{v}' THEN 1.0 ELSE 0.0 END AS n_name_{v}" for v in NATION_LEVELS) +
    " FROM of")

oracle("standard_scale", _ENC_CLS + "\nSELECT o_orderkey, o_orderstatus, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 4) AS {c}"
    for c in FEATURES_CLS) + " FROM enc")

oracle("low_variance_columns", _ENC_CLS + ",\nsc AS (SELECT " + ", ".join(
    f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}"
    for c in FEATURES_CLS) + ", 7.0::DOUBLE AS unit_flag FROM enc),\nsd AS (" + union(
    [f"SELECT '{c}' AS \"column\", stddev_samp({c}) AS std FROM sc" for c in [*FEATURES_CLS, "unit_flag"]]) +
    ")\nSELECT \"column\", std FROM sd WHERE std < 1e-6")

oracle("features_as_double", ORDER_FEATURES + """
SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice, c_acctbal,
  CAST(n_lines AS DOUBLE) AS n_lines, avg_discount, sum_qty FROM of""")

oracle("label_encode", """
WITH codes AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
               FROM (SELECT DISTINCT o_orderstatus AS v FROM orders WHERE o_orderstatus IS NOT NULL))
SELECT o_orderkey, code AS label FROM orders LEFT JOIN codes ON v = o_orderstatus""")


def _mi_sql(enc: str, features: list[str], target: str, discrete: bool) -> str:
    ybin = (f"CAST({target} AS VARCHAR)" if discrete else
            f"CAST(CASE WHEN max({target}) OVER () = min({target}) OVER () THEN 0 ELSE "
            f"least(floor(({target} - min({target}) OVER ()) / (max({target}) OVER () - "
            f"min({target}) OVER ()) * 32), 31) END AS INTEGER)::VARCHAR")
    filled = ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in features)
    longs = union([f"SELECT '{c}' AS feature, {c} AS x, y FROM base" for c in features])
    return (enc + f",\nbase0 AS (SELECT {filled}, {ybin} AS y FROM enc WHERE {target} IS NOT NULL)"
            ",\nbase AS (SELECT * FROM base0)"
            f",\nlong AS ({longs})"
            ",\nr AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM long GROUP BY feature)"
            ",\nj AS (SELECT long.feature, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / "
            "(hi - lo) * 32), 31) END AS INTEGER) AS b, y, count(*) AS n_by FROM long JOIN r "
            "ON long.feature = r.feature GROUP BY ALL)"
            ",\ns AS (SELECT feature, n_by, sum(n_by) OVER (PARTITION BY feature) AS n, "
            "sum(n_by) OVER (PARTITION BY feature, b) AS n_b, "
            "sum(n_by) OVER (PARTITION BY feature, y) AS n_y FROM j)"
            ",\nm AS (SELECT feature, round(greatest(sum(n_by / n * ln(n_by * n / (n_b * n_y))), 0), 6)"
            " AS mi FROM s GROUP BY feature)"
            "\nSELECT feature, mi, CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INTEGER) AS rk"
            " FROM m")


MI_CLS = _mi_sql(_ENC_CLS, FEATURES_CLS, "o_orderstatus", True)
oracle("mi_classification", MI_CLS)
oracle("mi_regression", _mi_sql(_ENC_REG, FEATURES_REG, "o_totalprice", False))
oracle("select_top_features", f"SELECT * FROM ({MI_CLS}) WHERE rk <= 10")
# Counts from the data: a text column with at most ten values is ordinal, else one-hot with at most 50
# levels (and one for the rest), the first dropped; a numeric column of no variance is left out.
_TEXT = ["o_orderpriority", "c_mktsegment", "n_name"]
_NUM = ["o_totalprice", "c_acctbal", "n_lines", "avg_discount", "sum_qty"]
oracle("feature_report", ORDER_FEATURES.rstrip().rstrip(",") + ",\nt AS (" + union(
    [f"SELECT '{c}' AS c, count(DISTINCT {c}) AS d, count(*) - count({c}) AS gaps FROM of" for c in _TEXT]) +
    "),\nv AS (" + union([f"SELECT '{c}' AS c, coalesce(stddev_pop({c}), 0) = 0 AS flat FROM of" for c in _NUM]) + """),
e AS (SELECT count(*) FILTER (WHERE d <= 10) AS ord, count(*) FILTER (WHERE d > 10) AS hot,
             coalesce(sum(CASE WHEN d > 10 THEN least(d, 50) + CASE WHEN d > 50 OR gaps > 0 THEN 1 ELSE 0 END - 1 END), 0) AS dummies
      FROM t),
n AS (SELECT count(*) AS nums, count(*) FILTER (WHERE flat) AS flats FROM v)
SELECT CAST(ord + hot + nums AS INTEGER) AS features_before, CAST(ord + dummies + nums - flats AS INTEGER) AS features_after,
  CAST(flats AS INTEGER) AS n_low_variance, CAST(ord + dummies + nums AS INTEGER) AS n_scaled,
  CAST(ord AS INTEGER) AS n_ordinal, CAST(hot AS INTEGER) AS n_one_hot,
  coalesce((SELECT list(c ORDER BY c) FROM v WHERE flat), []) AS dropped_low_variance,
  list_sort(list_concat((SELECT list(c) FROM t WHERE d <= 10), (SELECT list(c) FROM v),
    """ + f"{[f'n_name_{v}' for v in NATION_LEVELS]}" + """)) AS numeric_scaled,
  (SELECT list(c ORDER BY c) FROM t WHERE d <= 10) AS ordinal_encoded,
  (SELECT list(c ORDER BY c) FROM t WHERE d > 10) AS one_hot_encoded,
  (SELECT list(feature ORDER BY rk) FROM (""" + MI_CLS + """) WHERE rk <= 20) AS features_selected,
  (SELECT list(mi ORDER BY rk) FROM (""" + MI_CLS + """) WHERE rk <= 20) AS mi_scores,
  CAST(20 AS INTEGER) AS top_k, CAST(10 AS INTEGER) AS ordinal_cardinality_threshold, 'classification' AS task_type
FROM e, n""")


# ── split, metrics, ranking ──────────────────────────────────────────────────

def _split(table: str, key: str) -> str:
    return (f"(SELECT {key}, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST({key} AS VARCHAR)),"
            f" {key}) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS part "
            f"FROM {table})")


oracle("train_test_split", "SELECT * FROM " + _split("orders", "o_orderkey"))
oracle("split_sizes", "SELECT part, count(*) AS n FROM " + _split("orders", "o_orderkey") +
       " GROUP BY part")
oracle("split_partition_check", "WITH s AS " + _split("orders", "o_orderkey") + """
SELECT 'n_total' AS "check", count(*) AS n FROM orders
UNION ALL SELECT 'n_train', count(*) FROM s WHERE part = 'train'
UNION ALL SELECT 'n_test', count(*) FROM s WHERE part = 'test'
UNION ALL SELECT 'n_overlap', count(*) FROM (SELECT o_orderkey FROM s WHERE part = 'train'
  INTERSECT SELECT o_orderkey FROM s WHERE part = 'test')
UNION ALL SELECT 'n_missing', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)""")

BINARY_PREDS = """
WITH j AS (SELECT labels.doc_id, quality, toxic, n_chars FROM labels JOIN documents
           ON labels.doc_id = documents.doc_id),
preds AS (
  SELECT 'length_rule' AS model, doc_id, quality AS y, CAST(n_chars >= 1000 AS INTEGER) AS pred,
         n_chars / (n_chars + 1000.0) AS score FROM j
  UNION ALL SELECT 'hash_rule', doc_id, quality, CAST(doc_id % 3 = 0 AS INTEGER),
         (doc_id * 7919 % 1000) / 1000.0 FROM j
  UNION ALL SELECT 'toxic_rule', doc_id, quality, 1 - toxic,
         CASE WHEN toxic = 1 THEN 0.25 ELSE 0.75 END FROM j)"""

MULTI_PREDS = """
WITH sh AS (SELECT l_orderkey, avg(CAST(l_returnflag = 'A' AS DOUBLE)) AS p_F,
                   avg(CAST(l_returnflag = 'N' AS DOUBLE)) AS p_O,
                   avg(CAST(l_returnflag = 'R' AS DOUBLE)) AS p_P FROM lineitem GROUP BY l_orderkey),
preds AS (SELECT 'flag_share' AS model, o_orderkey, o_orderstatus AS y,
  CASE WHEN p_F >= p_O AND p_F >= p_P THEN 'F' WHEN p_O >= p_P THEN 'O' ELSE 'P' END AS pred,
  p_F, p_O, p_P FROM orders JOIN sh ON o_orderkey = l_orderkey)"""

REG_PREDS = """
WITH s AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS line_sum,
                  sum(l_extendedprice) AS gross_sum FROM lineitem GROUP BY l_orderkey),
preds AS (SELECT 'line_sum' AS model, o_orderkey, o_totalprice / 1000.0 AS y,
                 line_sum / 1000.0 AS pred FROM orders JOIN s ON o_orderkey = l_orderkey
          UNION ALL SELECT 'gross_sum', o_orderkey, o_totalprice / 1000.0, gross_sum / 1000.0
          FROM orders JOIN s ON o_orderkey = l_orderkey)"""

ACC = "SELECT model, round(avg(CAST(CAST(y AS VARCHAR) = CAST(pred AS VARCHAR) AS DOUBLE)), 4) AS accuracy FROM preds GROUP BY model"

PRF = """,
conf AS (SELECT model, CAST(y AS VARCHAR) AS t, CAST(pred AS VARCHAR) AS p, count(*) AS n
         FROM preds GROUP BY ALL),
contrib AS (SELECT model, t AS cls, n AS s, 0 AS pc, CASE WHEN t = p THEN n ELSE 0 END AS tp FROM conf
            UNION ALL SELECT model, p, 0, n, 0 FROM conf),
per AS (SELECT model, cls, sum(s) AS s, sum(pc) AS pc, sum(tp) AS tp FROM contrib GROUP BY ALL),
pr AS (SELECT model, s, CASE WHEN pc = 0 THEN 0.0 ELSE tp / pc END AS pr,
              CASE WHEN s = 0 THEN 0.0 ELSE tp / s END AS rc FROM per),
prf AS (SELECT model, round(sum(pr * s) / sum(s), 4) AS precision_weighted,
  round(sum(rc * s) / sum(s), 4) AS recall_weighted,
  round(sum(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END * s) / sum(s), 4)
    AS f1_weighted FROM pr GROUP BY model)"""

AUC_BIN = """,
h AS (SELECT model, CAST(score AS DOUBLE) AS score, count(*) FILTER (WHERE CAST(y AS VARCHAR) = '1') AS pos,
             count(*) FILTER (WHERE CAST(y AS VARCHAR) <> '1') AS neg FROM preds GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h),
auc AS (SELECT model, round(CASE WHEN sum(pos) * sum(neg) = 0 THEN NULL ELSE
        sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) END, 4) AS roc_auc FROM c GROUP BY model)"""

oracle("metric_accuracy", BINARY_PREDS + "\n" + ACC)
oracle("metric_prf_weighted", MULTI_PREDS + PRF + "\nSELECT * FROM prf")
oracle("metric_auc_binary", BINARY_PREDS + AUC_BIN + "\nSELECT * FROM auc")
oracle("metric_auc_ovr", MULTI_PREDS + """,
long AS (SELECT model, y, 'F' AS cls, p_F AS score FROM preds
         UNION ALL SELECT model, y, 'O', p_O FROM preds UNION ALL SELECT model, y, 'P', p_P FROM preds),
h AS (SELECT model, cls, score, count(*) FILTER (WHERE y = cls) AS pos,
             count(*) FILTER (WHERE y <> cls) AS neg FROM long GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, cls ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h),
a AS (SELECT model, cls, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc
      FROM c GROUP BY ALL HAVING sum(pos) * sum(neg) > 0)
SELECT model, round(avg(auc), 4) AS roc_auc FROM a
WHERE cls IN (SELECT DISTINCT y FROM preds) GROUP BY model""")
oracle("metric_regression", REG_PREDS + """
SELECT model, round(avg(abs(y - pred)), 4) AS mae, round(avg((y - pred) * (y - pred)), 4) AS mse,
  round(sqrt(avg((y - pred) * (y - pred))), 4) AS rmse,
  round(CASE WHEN var_pop(y) * count(*) = 0 THEN (CASE WHEN sum((y - pred) * (y - pred)) = 0
        THEN 1.0 ELSE 0.0 END) ELSE 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) END, 4)
    AS r2
FROM preds GROUP BY model""")

METRICS_LONG = BINARY_PREDS + PRF + AUC_BIN + f""",
acc AS ({ACC}),
wide AS (SELECT * FROM acc JOIN prf USING (model) LEFT JOIN auc USING (model)),
sp AS {_split('labels', 'doc_id')},
book AS (SELECT model, CAST(count(*) FILTER (WHERE part = 'train') AS DOUBLE) AS n_train,
                CAST(count(*) FILTER (WHERE part = 'test') AS DOUBLE) AS n_test
         FROM preds JOIN sp ON preds.doc_id = sp.doc_id GROUP BY model),
ml AS (SELECT model, 'accuracy' AS metric, accuracy AS value FROM wide
  UNION ALL SELECT model, 'f1_weighted', f1_weighted FROM wide
  UNION ALL SELECT model, 'precision_weighted', precision_weighted FROM wide
  UNION ALL SELECT model, 'recall_weighted', recall_weighted FROM wide
  UNION ALL SELECT model, 'roc_auc', roc_auc FROM wide WHERE roc_auc IS NOT NULL),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY f1_weighted DESC NULLS LAST, model) AS INTEGER) AS rk,
                  model, f1_weighted AS primary_score FROM wide)"""

oracle("metrics_long", METRICS_LONG + "\nSELECT * FROM ml")
oracle("rank_models", METRICS_LONG + "\nSELECT * FROM ranked")
_PIVOT = ("SELECT wide.model, accuracy, f1_weighted, precision_weighted, recall_weighted, roc_auc, "
          "NULL::DOUBLE AS train_duration_seconds, n_train, n_test FROM wide JOIN book USING (model)")
oracle("metrics_pivot", METRICS_LONG + "\n" + _PIVOT)
oracle("model_comparison", METRICS_LONG + f",\npv AS ({_PIVOT})\n"
       "SELECT ranked.*, accuracy, f1_weighted, precision_weighted, recall_weighted, roc_auc, "
       "train_duration_seconds, n_train, n_test FROM ranked JOIN pv USING (model)")
oracle("evaluation_summary", METRICS_LONG + """
SELECT 'f1_weighted' AS primary_metric, 'higher_is_better' AS direction,
  arg_min(model, rk) AS best_model, arg_min(primary_score, rk) AS best_score, count(*) AS n_models
FROM ranked""")


# ── chart data ───────────────────────────────────────────────────────────────

def _hist_sql(table: str, cols: list[str], density: bool, digits: int, bins: int = 30) -> str:
    long = union([f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {table} "
                  f"WHERE {c} IS NOT NULL" for c in cols])
    dens = (f", round(coalesce(n, 0) / (n_all * w), {digits}) AS density" if density else "")
    return f"""
WITH long AS ({long}),
r0 AS (SELECT "column", min(value) AS lo0, max(value) AS hi0, count(value) AS n_all FROM long GROUP BY 1),
r AS (SELECT "column", n_all, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
             CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0),
rw AS (SELECT *, (hi - lo) / {bins} AS w FROM r),
b AS (SELECT long."column", CAST(least(floor((value - lo) / w), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
      FROM long JOIN rw ON long."column" = rw."column" GROUP BY ALL),
g AS (SELECT rw.*, CAST(i AS INTEGER) AS bin FROM rw, range({bins}) t(i))
SELECT g."column", g.bin, round(lo + g.bin * w, {digits}) AS lo, round(lo + (g.bin + 1) * w, {digits}) AS hi,
  coalesce(n, 0) AS n{dens}
FROM g LEFT JOIN b ON g."column" = b."column" AND g.bin = b.bin"""


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]
oracle("histogram_density", _hist_sql("lineitem", LINE_NUMBERS, True, 6))
oracle("histogram_ten_bins", _hist_sql("lineitem", LINE_NUMBERS, True, 6, bins=10))
oracle("target_distribution_classes", """
WITH vc AS (SELECT 'o_orderpriority' AS "column", CAST(o_orderpriority AS VARCHAR) AS value, count(*) AS n
            FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2)
SELECT *, CAST(rk0 AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rk0 FROM vc)
WHERE rk0 <= 20""".replace("SELECT *, CAST(rk0", 'SELECT "column", value, n, CAST(rk0'))
oracle("target_distribution", _hist_sql("orders", ["o_totalprice"], False, 4))

oracle("kde_curve", """
WITH long AS (""" + union([f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM lineitem"
                           for c in LINE_NUMBERS]) + """),
st AS (SELECT "column", count(value) AS n, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx
       FROM long GROUP BY 1 HAVING count(value) >= 2 AND stddev_samp(value) > 0),
st2 AS (SELECT *, sd * pow(n, -0.2) AS bw, mn - (mx - mn) / 2 AS g0, 2 * (mx - mn) / 99 AS step FROM st),
wv AS (SELECT "column", value, count(*) AS wt FROM long GROUP BY ALL),
c AS (SELECT wv."column", CAST(gi AS INTEGER) AS gi, g0 + gi * step AS x, n, bw,
             wt * exp(-0.5 * ((g0 + gi * step - value) / bw) * ((g0 + gi * step - value) / bw)) AS k
      FROM wv JOIN st2 ON wv."column" = st2."column", range(100) t(gi))
SELECT "column", gi, round(x, 6) AS x,
  round(sum(k) * (1 / sqrt(2 * pi())) / (any_value(n) * any_value(bw)) * 1e6, 4) AS density_e6
FROM c GROUP BY "column", gi, x""")

oracle("box_stats", "WITH long AS (" + union(
    [f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM lineitem WHERE {c} IS NOT NULL"
     for c in LINE_NUMBERS]) + """),
q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT b."column", round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  round(min(value) FILTER (WHERE value >= lo AND value <= hi), 4) AS whisker_lo,
  round(max(value) FILTER (WHERE value >= lo AND value <= hi), 4) AS whisker_hi,
  count(*) FILTER (WHERE NOT (value >= lo AND value <= hi)) AS n_fliers
FROM long JOIN b ON long."column" = b."column" GROUP BY b."column", q1, median, q3""")

oracle("category_bars", "WITH vc AS (" + union(
    [f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM part "
     f"WHERE {c} IS NOT NULL GROUP BY 2" for c in ["p_name", "p_brand", "p_type"]]) + """),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rk
      FROM vc)
SELECT * FROM r WHERE rk <= 20""")

_TRI = LINE_NUMBERS
oracle("corr_lower_triangle", union(
    [f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
     f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 2) END AS corr "
     f"FROM lineitem" for i, a in enumerate(_TRI) for j, b in enumerate(_TRI) if i >= j]))


# ── run log and catalog ──────────────────────────────────────────────────────

RUN_EVENTS = """
WITH ev AS (SELECT user_id AS run_id, event_id AS seq, ts,
  CASE WHEN event_type IN ('signup', 'view') THEN 'pending' WHEN event_type = 'click' THEN 'running'
       WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' END AS status,
  CAST(user_id % 25 AS INTEGER) AS dataset_id,
  CASE WHEN event_type = 'error' THEN props END AS message FROM events),
latest AS (SELECT run_id, arg_min(dataset_id, seq) AS dataset_id, arg_max(status, seq) AS status,
  min(ts) AS created_at, max(ts) FILTER (WHERE status = 'running') AS started_at,
  max(ts) FILTER (WHERE status IN ('completed', 'failed')) AS completed_at,
  arg_max(message, seq) FILTER (WHERE message IS NOT NULL) AS error_message,
  count(*) AS n_events FROM ev GROUP BY run_id),
cat AS (SELECT n_nationkey AS dataset_id, n_name AS name, n_regionkey,
  (SELECT min(ts) FROM ev WHERE ev.dataset_id = n_nationkey) AS created_at FROM nation)"""

oracle("run_transitions_valid", RUN_EVENTS + """,
p AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY seq) AS prev FROM ev),
v AS (SELECT run_id, CASE WHEN prev IS NULL THEN status = 'pending'
  WHEN status = 'running' THEN prev = 'pending' WHEN status IN ('completed', 'failed') THEN TRUE
  ELSE FALSE END AS ok FROM p)
SELECT run_id, count(*) AS n_events, count(*) FILTER (WHERE NOT ok) AS n_invalid,
  count(*) FILTER (WHERE NOT ok) = 0 AS valid FROM v GROUP BY run_id""")
oracle("run_latest_state", RUN_EVENTS + "\nSELECT * FROM latest")
oracle("run_store_latest", RUN_EVENTS + "\nSELECT * FROM latest")
oracle("runs_by_status", RUN_EVENTS + """
SELECT run_id, status FROM latest WHERE status IN ('completed', 'failed')""")
oracle("run_counts", RUN_EVENTS + "\nSELECT dataset_id, count(*) AS n_runs FROM latest GROUP BY 1")
oracle("page_newest", RUN_EVENTS + """
SELECT dataset_id, name, created_at FROM cat ORDER BY created_at DESC NULLS LAST, dataset_id
LIMIT 10 OFFSET 5""")
oracle("page_deep", """
SELECT l_shipdate, l_orderkey, l_linenumber FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber
LIMIT 50 OFFSET (SELECT count(*) // 2 FROM lineitem)""")
oracle("runs_by_dataset", RUN_EVENTS + """
SELECT run_id, dataset_id, status, created_at FROM latest WHERE dataset_id = 7
ORDER BY created_at DESC, run_id LIMIT 20 OFFSET 0""")
oracle("first_by_name", RUN_EVENTS + """
SELECT dataset_id, name, created_at FROM cat WHERE name = 'NATION_3' ORDER BY dataset_id LIMIT 1""")
oracle("run_with_dataset", RUN_EVENTS + """
SELECT latest.dataset_id, run_id, name, status FROM latest JOIN cat ON latest.dataset_id = cat.dataset_id""")
oracle("runs_after_delete", RUN_EVENTS + """
SELECT dataset_id, run_id, status FROM latest
WHERE dataset_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
oracle("dataset_latest", """
WITH p AS (SELECT CAST(user_id % 25 AS INTEGER) AS dataset_id, event_id AS version,
  CASE WHEN value > 50 THEN 'ds_' || event_id END AS name,
  CASE WHEN value <= 80 THEN props END AS description FROM events)
SELECT dataset_id, arg_max(name, version) FILTER (WHERE name IS NOT NULL) AS name,
  arg_max(description, version) FILTER (WHERE description IS NOT NULL) AS description,
  max(version) AS version FROM p GROUP BY dataset_id""")
oracle("stage_timeline", RUN_EVENTS + """,
p AS (SELECT *, lag(ts) OVER (PARTITION BY run_id ORDER BY seq) AS prev_ts FROM ev)
SELECT run_id, seq, status AS stage, CASE WHEN status = 'failed' THEN 'error' ELSE 'success' END AS status,
  round(coalesce(epoch_us(ts) - epoch_us(prev_ts), 0) / 1e6, 3) AS duration_seconds, message AS error
FROM p""")
oracle("run_errors", RUN_EVENTS + """,
f AS (SELECT run_id, message, seq FROM ev WHERE message IS NOT NULL)
SELECT run_id, string_agg(message, '; ' ORDER BY seq) AS errors FROM f GROUP BY run_id""")
oracle("run_outcome", RUN_EVENTS + """
SELECT run_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'completed' END AS outcome,
  count(*) FILTER (WHERE status = 'failed') AS n_errors FROM ev GROUP BY run_id""")


def _registry(table: str, cols: list[tuple[str, str]]) -> str:
    arr = "[" + ", ".join(f"'{c}:{t}'" for c, t in cols) + "]"
    return (f"SELECT '{table}' AS name, count(*) AS n_rows, {len(cols)} AS n_cols, {arr} AS columns "
            f"FROM {table}")


_N, _C, _D = "numeric", "categorical", "datetime"
oracle("dataset_registry", union([
    _registry("orders", [("o_orderkey", _N), ("o_custkey", _N), ("o_orderstatus", _C),
                         ("o_totalprice", _N), ("o_orderdate", _D), ("o_orderpriority", _C)]),
    _registry("customer", [("c_custkey", _N), ("c_name", _C), ("c_nationkey", _N),
                           ("c_acctbal", _N), ("c_mktsegment", _C)]),
    _registry("part", [("p_partkey", _N), ("p_name", _C), ("p_brand", _C), ("p_type", _C),
                       ("p_size", _N), ("p_retailprice", _N)]),
    _registry("lineitem", [(c, _N) for c in LINEITEM_NUMERIC] +
              [("l_returnflag", _C), ("l_linestatus", _C), ("l_shipdate", _D)]),
]))


# ── previews, scalar functions, inference, plan and report ───────────────────

oracle("preview_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
oracle("safe_sample", """
SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN isnan(c_acctbal) OR isinf(c_acctbal) THEN NULL ELSE c_acctbal END AS c_acctbal,
  c_mktsegment FROM customer ORDER BY c_custkey LIMIT 5""")
oracle("safe_identifier", r"""
SELECT page_id, substring(regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g'), 1, 60) AS safe_url
FROM pages""")

_TEXT_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "o_orderpriority"]


def _infer_sql(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return f"""SELECT '{c}' AS "column", CASE
  WHEN count({v}) = 0 THEN 'double'
  WHEN count(*) FILTER (WHERE {v} IN ('True','False','TRUE','FALSE','true','false')) = count({v}) THEN 'boolean'
  WHEN count(*) FILTER (WHERE regexp_full_match({v}, '\\s*[+-]?[0-9]+\\s*')) = count({v}) THEN 'bigint'
  WHEN count(*) FILTER (WHERE TRY_CAST(trim({v}) AS DOUBLE) IS NOT NULL) = count({v}) THEN 'double'
  ELSE 'string' END AS inferred_type FROM orders"""


oracle("column_types", "WITH t AS (" + union([_infer_sql(c) for c in _TEXT_COLS]) + """)
SELECT "column", inferred_type, CASE WHEN inferred_type = 'boolean' THEN 'boolean'
  WHEN inferred_type IN ('bigint', 'double') THEN 'numeric' ELSE 'categorical' END AS label FROM t""")

_PLAN_TEXT = "list_filter([" + ", ".join(
    f"CASE WHEN typeof(any_value({c})) {{}} 'VARCHAR' THEN '{c}' END" for c in DIRTY_COLS if c != "target"
) + "], lambda c: c IS NOT NULL)"
_PLAN_HIGH = "list_sort(list_filter([" + ", ".join(
    f"CASE WHEN round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) > 50 THEN '{c}' END"
    for c in DIRTY_COLS) + "], lambda c: c IS NOT NULL))"
oracle("plan_profile", DIRTY + f""",
p AS (SELECT count(*) AS n_rows, {len(DIRTY_COLS)} AS n_cols,
  CASE WHEN typeof(any_value(target)) = 'VARCHAR' OR count(DISTINCT target) <= 20 THEN 'classification'
       ELSE 'regression' END AS task_type,
  {_PLAN_TEXT.replace("{}", "<>")} AS numeric_features, {_PLAN_TEXT.replace("{}", "=")} AS categorical_features,
  count(DISTINCT target) AS n_target_values,
  (count(*) FILTER (WHERE {" OR ".join(f"{c} IS NULL" for c in DIRTY_COLS)})) > 0 AS has_missing,
  {_PLAN_HIGH} AS high_missing FROM dirty)
SELECT *, len(numeric_features) + len(categorical_features) AS n_features, len(numeric_features) AS n_numeric,
  len(categorical_features) AS n_categorical, len(high_missing) AS n_high_missing,
  ['random_forest', 'logistic_regression', 'xgboost'] AS models,
  ['eda', 'cleaning', 'feature_engineering', 'training', 'evaluation', 'report'] AS steps FROM p""")

def chain(*ctes: str) -> str:
    """Join several ``WITH a AS (...)`` prefixes into one WITH list."""
    parts = [c.strip() for c in ctes]
    return "\nWITH " + ",\n".join(p[len("WITH"):].strip() if p.upper().startswith("WITH") else p
                                  for p in parts)


_MISSING_CTE = "m AS (" + union(
    [f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
     f"count(*) AS n_rows FROM dirty" for c in DIRTY_COLS]) + ")"

def _facts(section: int, sql: str, columns: list[str]) -> str:
    return union([f"SELECT {section} AS section, '{c}' AS item, CAST({c} AS VARCHAR) AS value FROM ({sql})"
                  for c in columns])


oracle("report_sections", "WITH parts AS (" + union([
    _facts(1, f"SELECT n_rows, n_cols FROM ({ORACLES['plan_profile']})", ["n_rows", "n_cols"]),
    _facts(2, ORACLES["plan_profile"], ["n_rows", "n_cols", "task_type", "n_features", "n_numeric", "n_categorical",
                                        "has_missing", "n_high_missing"]),
    "SELECT 3, \"column\", printf('%.2f', round(CAST(n_missing AS DOUBLE) / n_rows * 100, 2)) FROM (" + DIRTY + ", m AS ("
    + union([f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_missing, count(*) AS n_rows "
             f"FROM dirty" for c in DIRTY_COLS]) + ") SELECT * FROM m WHERE n_missing > 0)",
    _facts(4, ORACLES["cleaning_report"], ["rows_before", "rows_after", "rows_dropped", "duplicates_removed",
                                           "target_missing_dropped"]),
    _facts(5, ORACLES["feature_report"], ["features_before", "features_after", "n_low_variance", "n_scaled",
                                          "n_ordinal", "n_one_hot"]),
    f"SELECT 6, model || ':' || metric, printf('%.4f', value) FROM ({ORACLES['metrics_long']})",
    f"SELECT 7, CAST(rk AS VARCHAR) || ':' || model, printf('%.4f', primary_score) FROM ({ORACLES['rank_models']})",
    f"SELECT 8, 'best_model', model FROM ({ORACLES['rank_models']}) WHERE rk = 1",
    f"SELECT 9, stage || ':' || status, CAST(count(*) AS VARCHAR) FROM ({ORACLES['stage_timeline']}) GROUP BY stage, status",
    union([f"SELECT 10, '{c}', '{'categorical' if c in ('flag', 'target') else 'numeric'}'" for c in DIRTY_COLS])]) + """)
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY item) AS INTEGER) AS "row", item, value
FROM parts""")

# ── models ───────────────────────────────────────────────────────────────────

oracle("train_linreg", ORDER_FEATURES + """
SELECT round(regr_slope(o_totalprice, sum_qty), 4) AS slope,
  round(regr_intercept(o_totalprice, sum_qty), 4) AS intercept FROM of WHERE sum_qty IS NOT NULL""")

# Two-feature least squares by the normal equations; orders without lines count as 0 lines.
oracle("train_linreg_two", ORDER_FEATURES.rstrip().rstrip(",") + """,
d AS (SELECT coalesce(n_lines, 0)::DOUBLE AS a, c_acctbal AS b, o_totalprice / 1000.0 AS y FROM of),
s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb,
             avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM d),
w AS (SELECT (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb, ma, mb, my
      FROM s)
SELECT round(my - wa * ma - wb * mb, 4) AS intercept, round(wa, 4) AS w_lines, round(wb, 6) AS w_balance FROM w""")
