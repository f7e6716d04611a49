"""Feature encoding and scaling.

Fitted parameters (category codes, kept categories, means and standard
deviations) are small tables - at most ``threshold`` or 50 categories per
column, one row per scaled column - so they are collected once and applied
as literal maps and arithmetic inside a single projection (whole-stage
codegen, no join per column).
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import (CATEGORICAL, NUMERIC, as_double, chunks, col,
                                       column_labels, long_form, q, sql_double, sql_finite, sql_lit)
from tabloom.functions.ranking import top_k_per_group
from tabloom.session import cut_lineage

# Fixed values of the reference behaviour.
ORDINAL_CARDINALITY_THRESHOLD = 10
OHE_MAX_CATEGORIES = 50
OTHER = "__other__"
MISSING_TEXT = "nan"            # text a missing category takes before ordinal encoding
NEAR_ZERO_VARIANCE = 1e-6
UNKNOWN_CODE = -1.0


def split_categoricals(df: DataFrame, columns: list[str],
                       threshold: int = ORDINAL_CARDINALITY_THRESHOLD) -> tuple[list[str], list[str]]:
    """(ordinal columns with <= threshold distinct non-missing values, the rest)."""
    if not columns:
        return [], []
    long = long_form(df, columns, "string").where(F.col("value").isNotNull())
    # Distinct count capped at threshold + 1 per column: enough to decide.
    per = long.select("column", "value").distinct().groupBy("column").agg(
        F.count(F.lit(1)).alias("n"))
    n = {r["column"]: r["n"] for r in per.collect()}
    ordinal = [c for c in columns if n.get(c, 0) <= threshold]
    return ordinal, [c for c in columns if c not in ordinal]


def fit_ordinal(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Codes 0..k-1 in sorted text order; a missing value counts as ``"nan"``.

    For the low-cardinality columns of :func:`split_categoricals`; a column
    with more than ``ORDINAL_CARDINALITY_THRESHOLD`` values is refused, since
    its codes would not fit a literal map (:func:`label_encode` joins instead).
    """
    if not columns:
        return {}
    wide = [c for c in split_categoricals(df, columns)[1]]
    if wide:
        raise ValueError(f"too many values for ordinal codes: {wide}")
    texts = df.select(*[F.coalesce(col(c).cast("string"), F.lit(MISSING_TEXT)).alias(c)
                        for c in columns])
    cats = long_form(texts, columns, "string", clean=False).select("column", "value").distinct()
    found: dict[str, list[str]] = {}
    for r in cats.collect():                 # bounded: <= threshold + 1 values per column
        found.setdefault(r["column"], []).append(r["value"])
    return {c: {v: float(i) for i, v in enumerate(sorted(found.get(c, [])))} for c in columns}


def apply_ordinal(df: DataFrame, codes: dict[str, dict[str, float]]) -> DataFrame:
    """Replace each column by its code (DOUBLE); unseen values get -1.
    One projection; each column is a literal-map lookup."""
    def enc(c):
        m = ", ".join(f"{sql_lit(k)}, {sql_lit(float(v))}" for k, v in codes[c].items())
        key = f"coalesce(CAST({q(c)} AS STRING), {sql_lit(MISSING_TEXT)})"
        lookup = f"map({m})[{key}]" if m else "CAST(NULL AS DOUBLE)"
        return f"coalesce({lookup}, {sql_lit(UNKNOWN_CODE)}) AS {q(c)}"
    return df.selectExpr(*[enc(c) if c in codes else q(c) for c in df.columns])


def ordinal_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    return apply_ordinal(df, fit_ordinal(df, columns))


def fit_top_categories(df: DataFrame, columns: list[str],
                       k: int = OHE_MAX_CATEGORIES) -> dict[str, list[str]]:
    """The ``k`` most frequent values per column (ties: smaller value first)."""
    if not columns:
        return {}
    long = long_form(df, columns, "string").where(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    top = top_k_per_group(vc, ["column"], [F.desc("n"), F.asc("value")], k, salt_on=F.col("value"))
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in top.collect():                  # bounded: <= k rows per column
        out[r["column"]].append(r["value"])
    return out


def apply_rare_to_other(df: DataFrame, keep: dict[str, list[str]]) -> DataFrame:
    """Values outside the kept set (and missing values) become ``__other__``."""
    def cap(c):
        v = f"CAST({q(c)} AS STRING)"
        kept = ", ".join(sql_lit(x) for x in keep[c])
        cond = f"{v} IN ({kept})" if kept else "FALSE"
        return f"CASE WHEN {cond} THEN {v} ELSE {sql_lit(OTHER)} END AS {q(c)}"
    return df.selectExpr(*[cap(c) if c in keep else q(c) for c in df.columns])


def rare_to_other(df: DataFrame, columns: list[str], k: int = OHE_MAX_CATEGORIES) -> DataFrame:
    return apply_rare_to_other(df, fit_top_categories(df, columns, k))


def one_hot_levels(keep: dict[str, list[str]], present_other: dict[str, bool]) -> dict[str, list[str]]:
    """Dummy levels per column: sorted categories (with ``__other__`` when it
    occurs), the first one dropped."""
    out = {}
    for c, cats in keep.items():
        levels = sorted(set(cats) | ({OTHER} if present_other.get(c) else set()))
        out[c] = levels[1:]
    return out


def apply_one_hot(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Replace each column by 0/1 DOUBLE dummies ``{col}_{level}`` appended at the end."""
    kept = [q(c) for c in df.columns if c not in levels]
    dummies = [f"CASE WHEN {q(c)} = {sql_lit(v)} THEN 1.0D ELSE 0.0D END AS {q(f'{c}_{v}')}"
               for c in levels for v in levels[c]]
    return df.selectExpr(*kept, *dummies)


def one_hot_encode(df: DataFrame, columns: list[str], k: int = OHE_MAX_CATEGORIES) -> DataFrame:
    """Cap to the k most frequent categories, then one-hot with the first level dropped."""
    keep = fit_top_categories(df, columns, k)
    capped = apply_rare_to_other(df, keep)
    other = _has_other(capped, columns)
    return apply_one_hot(capped, one_hot_levels(keep, other))


def _has_other(capped: DataFrame, columns: list[str]) -> dict[str, bool]:
    if not columns:
        return {}
    row = capped.agg(*[F.max((col(c) == F.lit(OTHER)).cast("int")).alias(f"_o{i}")
                       for i, c in enumerate(columns)]).first()
    return {c: bool(row[f"_o{i}"]) for i, c in enumerate(columns)}


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, int]]:
    """``{column: (mean, population std, n)}`` in one wide aggregate pass."""
    out: dict[str, tuple[float, float, int]] = {}
    for chunk in (chunks(list(enumerate(columns)), 30) if columns else []):
        aggs = []
        for i, c in chunk:
            v = sql_finite(df, c)       # an infinite value stays one when scaled, but moves no other
            aggs += [f"avg({v}) AS m{i}", f"stddev_pop({v}) AS s{i}", f"count({v}) AS n{i}"]
        r = df.selectExpr(*aggs).first()
        out.update({c: (r[f"m{i}"], r[f"s{i}"], r[f"n{i}"]) for i, c in chunk})
    return out


def _moments(counts: list[tuple[float, int]]) -> tuple[float | None, float | None, int]:
    """(mean, population std, n) of ``(value, rows)`` counts, as :func:`fit_scaler` gives them."""
    n = sum(k for _, k in counts)
    if n == 0:
        return None, None, 0
    mean = sum(x * k for x, k in counts) / n
    return mean, math.sqrt(sum(k * (x - mean) ** 2 for x, k in counts) / n), n


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float, int]]) -> DataFrame:
    """``(x - mean) / std``; a zero std divides by 1."""
    def sc(c):
        m, s, _ = stats[c]
        scale = s if s not in (None, 0.0) else 1.0
        mean = m if m is not None else 0.0
        return f"({sql_double(df, c)} - {sql_lit(float(mean))}) / {sql_lit(float(scale))} AS {q(c)}"
    return df.selectExpr(*[sc(c) if c in stats else q(c) for c in df.columns])


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, columns))


def low_variance_columns(df: DataFrame, columns: list[str],
                         threshold: float = NEAR_ZERO_VARIANCE) -> DataFrame:
    """``(column, std)`` for columns whose sample std is below ``threshold``."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column STRING, std DOUBLE")
    long = long_form(df, columns, "double")
    s = long.groupBy("column").agg(F.stddev_samp("value").alias("std"))
    return s.where(F.col("std") < threshold)


def features_as_double(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast features to DOUBLE (booleans become 0/1)."""
    return df.select(*[as_double(df, c).alias(c) for c in columns])


def fit_labels(df: DataFrame, target: str) -> DataFrame:
    """``(label, code)``: distinct target values in sorted text order, codes 0..k-1.

    The labels are sorted by range partitions; a partition's codes start
    after the labels of the earlier ones (one count per partition).
    """
    labels = cut_lineage(df.select(col(target).cast("string").alias("label")).where(F.col("label").isNotNull())
                         .distinct().orderBy("label").withColumn("at", F.monotonically_increasing_id()))
    part, inner = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = labels.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return labels.withColumn("part", part).join(base, "part").select(
        "label", (F.col("base") + inner).cast("int").alias("code"))


def label_encode(df: DataFrame, target: str, labels: DataFrame | None = None,
                 out: str | None = None) -> DataFrame:
    """Text labels -> codes 0..k-1 in sorted order (INT), by a join with the
    label table; a missing target has no code."""
    labels = labels if labels is not None else fit_labels(df, target)
    out = out or target
    codes = labels.select(F.col("label").alias("_label_text"), F.col("code").alias("_label_code"))
    joined = df.join(codes, col(target).cast("string") == F.col("_label_text"), "left")
    cols = [F.col("_label_code").alias(c) if c == out else col(c) for c in df.columns]
    return joined.select(*cols, *([] if out in df.columns else [F.col("_label_code").alias(out)]))


@dataclass
class FeatureModel:
    """Everything fitted by :func:`fit_features`, reusable on new rows."""
    target: str
    id_cols: list[str]
    ordinal: dict[str, dict[str, float]] = field(default_factory=dict)
    top_categories: dict[str, list[str]] = field(default_factory=dict)
    one_hot: dict[str, list[str]] = field(default_factory=dict)
    scaler: dict[str, tuple[float, float, int]] = field(default_factory=dict)
    low_variance: list[str] = field(default_factory=list)
    features_before: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Encode, one-hot and scale in ONE projection where every output
        column is a single expression over one raw column (no nested CASE
        from stacked projections, so generated code stays small)."""
        return df.selectExpr(*self.output_exprs(df))

    def encode(self, df: DataFrame) -> DataFrame:
        """Like :meth:`transform` without scaling (codes and 0/1 dummies)."""
        return df.selectExpr(*self.output_exprs(df, scaled=False))

    def output_exprs(self, df: DataFrame, scaled: bool = True) -> list[str]:
        self._scale_on = scaled
        out = []
        dummies = []
        for c in df.columns:
            if c in self.one_hot:
                raw = f"CAST({q(c)} AS STRING)"
                kept = ", ".join(sql_lit(x) for x in self.top_categories.get(c, []))
                for v in self.one_hot[c]:
                    if v == OTHER:
                        cond = f"{raw} IS NULL" + (f" OR NOT {raw} IN ({kept})" if kept else
                                                   " OR TRUE")
                    else:
                        cond = f"{raw} = {sql_lit(v)}"
                    name = f"{c}_{v}"
                    if name not in self.low_variance:
                        dummies.append(self._scaled(f"CASE WHEN {cond} THEN 1.0D ELSE 0.0D END",
                                                    name))
                continue
            if c in self.low_variance:
                continue
            if c in self.ordinal:
                m = ", ".join(f"{sql_lit(k)}, {sql_lit(float(v))}" for k, v in self.ordinal[c].items())
                key = f"coalesce(CAST({q(c)} AS STRING), {sql_lit(MISSING_TEXT)})"
                lookup = f"map({m})[{key}]" if m else "CAST(NULL AS DOUBLE)"
                out.append(self._scaled(f"coalesce({lookup}, {sql_lit(UNKNOWN_CODE)})", c))
            elif c in self.scaler:
                out.append(self._scaled(sql_double(df, c), c))
            else:
                out.append(q(c))
        return out + dummies

    def _scaled(self, expr: str, name: str) -> str:
        if name not in self.scaler or not getattr(self, "_scale_on", True):
            return f"{expr} AS {q(name)}"
        m, s, _ = self.scaler[name]
        scale = s if s not in (None, 0.0) else 1.0
        mean = m if m is not None else 0.0
        return f"({expr} - {sql_lit(float(mean))}) / {sql_lit(float(scale))} AS {q(name)}"

    def save(self, spark, path: str) -> str:
        """Write the fitted parameters as one JSON text row (small: a few values per column)."""
        text = json.dumps(asdict(self), ensure_ascii=True)
        spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("errorifexists").text(path)
        return path

    @classmethod
    def load(cls, spark, path: str) -> "FeatureModel":
        data = json.loads(spark.read.text(path).first()["value"])
        data["scaler"] = {c: tuple(v) for c, v in data["scaler"].items()}
        return cls(**data)

    @property
    def feature_columns(self) -> list[str]:
        base = [c for c in self.features_before if c not in self.one_hot]
        dummies = [f"{c}_{v}" for c in self.one_hot for v in self.one_hot[c]]
        return [c for c in base + dummies if c not in self.low_variance]


def fit_features(df: DataFrame, target: str, id_cols: tuple[str, ...] = (),
                 ordinal_threshold: int = ORDINAL_CARDINALITY_THRESHOLD,
                 drop_low_variance: bool = True) -> FeatureModel:
    """Fit ordinal codes, one-hot levels and scaler on ``df`` (target and
    id columns are carried, never encoded)."""
    labels = column_labels(df)
    feats = [c for c in df.columns if c != target and c not in id_cols]
    fm = FeatureModel(target=target, id_cols=list(id_cols), features_before=feats)
    # Fitting reads the table several times (category counts, kept levels,
    # scaler moments); keep it for the duration of the fit.
    owned = not df.storageLevel.useMemory and not df.storageLevel.useDisk
    if owned:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _fit_into(fm, df, labels, feats, target, id_cols, ordinal_threshold, drop_low_variance)
    finally:
        if owned:
            df.unpersist()
    return fm


def _fit_into(fm, df, labels, feats, target, id_cols, ordinal_threshold, drop_low_variance):
    cats = [c for c in feats if labels[c] == CATEGORICAL]
    coded: dict[str, list[tuple[float, int]]] = {}      # (value, rows) of every encoded column
    if cats:
        # One value-count table (NULL kept as its own value) answers every
        # categorical question: distinct counts, ordinal code lists, the most
        # frequent levels and whether "__other__" occurs.
        vc = (long_form(df, cats, "string")
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
              .persist(StorageLevel.MEMORY_AND_DISK))
        try:
            stats = {r["column"]: (r["d"], r["nulls"] > 0, r["n"]) for r in vc.groupBy("column").agg(
                F.count("value").alias("d"), F.sum("n").alias("n"),
                F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls")).collect()}
            ordinal = [c for c in cats if stats.get(c, (0, False, 0))[0] <= ordinal_threshold]
            ohe = [c for c in cats if c not in ordinal]
            found: dict[str, dict[str, int]] = {c: {} for c in ordinal}
            if ordinal:
                for r in vc.where(F.col("column").isin(ordinal)).collect():   # <= threshold + 1 rows per column
                    text = r["value"] if r["value"] is not None else MISSING_TEXT
                    found[r["column"]][text] = found[r["column"]].get(text, 0) + r["n"]
            fm.ordinal = {c: {v: float(i) for i, v in enumerate(sorted(found[c]))} for c in ordinal}
            coded.update({c: [(x, found[c][v]) for v, x in fm.ordinal[c].items()] for c in ordinal})
            kept: dict[str, list[str]] = {c: [] for c in ohe}
            taken: dict[str, dict[str, int]] = {c: {} for c in ohe}
            if ohe:
                top = top_k_per_group(vc.where(F.col("column").isin(ohe) & F.col("value").isNotNull()),
                                      ["column"], [F.desc("n"), F.asc("value")], OHE_MAX_CATEGORIES,
                                      salt_on=F.col("value"))
                for r in top.collect():                    # <= 50 rows per column
                    kept[r["column"]].append(r["value"])
                    taken[r["column"]][r["value"]] = r["n"]
            fm.top_categories = kept
            other = {c: stats[c][1] or stats[c][0] > len(kept[c]) for c in ohe}
            fm.one_hot = one_hot_levels(kept, other)
            for c in ohe:
                n = stats[c][2]
                for v in fm.one_hot[c]:
                    ones = n - sum(taken[c].values()) if v == OTHER else taken[c][v]
                    coded[f"{c}_{v}"] = [(0.0, n - ones), (1.0, ones)]
        finally:
            vc.unpersist()
    encoded = fm.encode(df)
    enc_labels = column_labels(encoded)
    scale_cols = [c for c in encoded.columns
                  if c != target and c not in id_cols and enc_labels[c] == NUMERIC]
    # Codes and dummies are scaled by their value counts; the table is read for the other columns only.
    if len({c.lower() for c in encoded.columns}) < len(encoded.columns):
        coded = {}                      # two columns of one name are an error of the table's scaler
    scanned = fit_scaler(encoded, [c for c in scale_cols if c not in coded])
    fm.scaler = {c: scanned[c] if c in scanned else _moments(coded[c]) for c in scale_cols}
    if drop_low_variance:
        # After scaling, a column has sample std 0 exactly when its population
        # std was 0 (it is divided by 1 and becomes all zeros); otherwise its
        # sample std is sqrt(n/(n-1)) >= 1. Decided from the scaler statistics
        # with no extra pass over the data.
        fm.low_variance = [c for c, (_, s, n) in fm.scaler.items() if n >= 2 and s == 0.0]
