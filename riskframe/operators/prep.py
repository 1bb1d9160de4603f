"""Fit/transform preprocessing (F1-F12, P4-P19) as a ``pyspark.ml`` Estimator/Model.

``fit`` learns on TRAIN, in a fixed number of jobs whatever the width:

1. one exact-quantile pass for q1/median/q3 of every numeric column (after
   sentinel codes become NULL);
2. one exact-quantile pass for the P99 of the debt ratio on imputed values;
3. one ``groupBy`` of the category for the smoothed target encoding (or the
   top-N frequency list when there is no target).

Only small results come back: 3 numbers per column and one cap; the encoding
stays a written table. ``transform`` is a projection of column expressions
(whole-stage codegen, no UDF) plus a left join to the encoding table.

Dummy layouts are learned at fit time (sorted level names), so every batch
scored later has the same columns whatever levels it happens to contain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..session import materialize
from ..sources.tables import load_params, save_params
from .prefix import exact_quantiles, unpivot
from .quality import replace_sentinels
from .saved import Stateful

X7_LABELS = [s.lower() for s in C.X7_LABELS]


class _PrepParams(Params):
    imputeStrategy = Param(Params._dummy(), "imputeStrategy", "median | mean | most_frequent", TypeConverters.toString)
    outlierFactor = Param(Params._dummy(), "outlierFactor", "IQR multiple of the clip fence", TypeConverters.toFloat)
    topN = Param(Params._dummy(), "topN", "categories kept as dummies without a target", TypeConverters.toInt)
    addMissingFlags = Param(Params._dummy(), "addMissingFlags", "add code and null flags", TypeConverters.toBoolean)
    targetEncode = Param(Params._dummy(), "targetEncode", "smoothed target encoding of the category", TypeConverters.toBoolean)
    smoothing = Param(Params._dummy(), "smoothing", "prior weight k of the encoding", TypeConverters.toFloat)
    labelCol = Param(Params._dummy(), "labelCol", "target column ('' for none)", TypeConverters.toString)
    numericCols = Param(Params._dummy(), "numericCols", "numeric feature columns", TypeConverters.toListString)
    categoryCol = Param(Params._dummy(), "categoryCol", "category column", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(
            imputeStrategy="median", outlierFactor=3.0, topN=25, addMissingFlags=True, targetEncode=True,
            smoothing=10.0, labelCol=C.TARGET, numericCols=list(C.NUMERIC), categoryCol="x9",
        )


class RiskPreprocessor(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    """preprocessing estimator; parameters as in the reference, plus column roles."""

    def __init__(self, **kwargs):
        super().__init__()
        self._set(**kwargs)

    def _fit(self, df: DataFrame) -> "RiskPreprocessorModel":
        g = self.getOrDefault
        label = g(self.labelCol)
        cat = g(self.categoryCol)
        num = [c for c in g(self.numericCols) if c in df.columns]
        clean = replace_sentinels(df, columns=num)
        factor = g(self.outlierFactor)

        # fences and medians of every column in one quantile pass
        qs = exact_quantiles(unpivot(clean, num), "value", [0.25, 0.5, 0.75], within=["feature"], names=["q1", "q2", "q3"])
        stats = {r["feature"]: r for r in qs.collect()}  # one row per column
        bounds, fill = {}, {}
        for c in num:
            r = stats.get(c)
            if r is None:  # all-NULL column at fit: no fence, impute 0 (ledger 10)
                bounds[c], fill[c] = (None, None), 0.0
                continue
            iqr = r["q3"] - r["q1"]
            bounds[c] = (r["q1"] - factor * iqr, r["q3"] + factor * iqr)
            fill[c] = r["q2"]
        strategy = g(self.imputeStrategy)
        if strategy == "mean":
            row = clean.agg(*[F.avg(c).alias(c) for c in num]).first()
            fill = {c: (row[c] if row[c] is not None else 0.0) for c in num}
        elif strategy == "most_frequent":
            long = unpivot(clean, num).where(F.col("value").isNotNull())
            cnt = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
            # most frequent value, smallest on ties (as sklearn)
            top = cnt.groupBy("feature").agg(F.max(F.struct(F.col("n").alias("n"), (-F.col("value")).alias("neg"))).alias("m"))
            got = {r["feature"]: -r["m"]["neg"] for r in top.collect()}
            fill = {c: got.get(c, 0.0) for c in num}

        # P99 of x2 / max(x1 or its median when 0, 1) on imputed, unclipped TRAIN values
        ratio_cap, den_fill = None, None
        if "x1" in num and "x2" in num:
            imp = clean.select(*[F.coalesce(F.col(c), F.lit(float(fill[c]))).alias(c) for c in ("x1", "x2")])
            if strategy == "median":
                den_fill = fill["x1"]  # median of a column imputed with its median is that median
            else:
                den_fill = exact_quantiles(imp, "x1", [0.5], names=["m"]).first()["m"]
            ratio = imp.select((F.col("x2") / F.greatest(F.coalesce(F.nullif(F.col("x1"), F.lit(0.0)), F.lit(float(den_fill))), F.lit(1.0))).alias("r"))
            ratio_cap = exact_quantiles(ratio, "r", [0.99], names=["p99"]).first()["p99"]

        # one small aggregate: levels of the ordinal feature present in TRAIN (a set of at
        # most len(levels) + 1 values, bounded by construction) and the global target mean
        use_target = bool(label) and label in df.columns and cat in df.columns and g(self.targetEncode)
        small = []
        if "x8" in num:
            lv = F.coalesce(F.col("x8"), F.lit(float(fill["x8"])))
            small.append(F.collect_set(X.ordinal_level(lv, C.X8_LEVELS)).alias("levels"))
        if use_target:
            small.append(F.avg(label).alias("mean"))
        row = clean.agg(*small).first() if small else None
        x8_levels = sorted(row["levels"]) if "x8" in num else []

        # category encoding
        enc_df, global_mean, top_levels = None, 0.0, None
        if cat in df.columns:
            key = F.coalesce(F.col(cat), F.lit(C.UNKNOWN_CATEGORY)).alias("level")
            if use_target:
                global_mean = row["mean"]
                enc_df = target_encoding_table(df, cat, label, float(g(self.smoothing)), global_mean)
                # always a join, at every category count: AQE sizes it at run time
                enc_df = materialize(enc_df.select("level", "encoding"), "target_encoding")
            else:
                n_top = g(self.topN)
                counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
                top = [r["level"] for r in counts.orderBy(F.col("n").desc(), F.col("level")).limit(n_top).collect()]
                has_other = counts.count() > len(top)
                top_levels = sorted(top + ([C.OTHER_CATEGORY] if has_other else []))
                top_levels = {"top": top, "layout": top_levels}

        model = RiskPreprocessorModel(
            state={
                "numeric": num, "bounds": bounds, "fill": fill, "ratio_cap": ratio_cap, "den_fill": den_fill,
                "x8_levels": x8_levels, "global_mean": global_mean, "top_levels": top_levels,
                "category": cat, "flags": g(self.addMissingFlags),
            },
            encoding_df=enc_df,
        )
        return self._copyValues(model)


class RiskPreprocessorModel(Model, _PrepParams, Stateful):
    """Fitted preprocessing; ``transform`` is one projection (+ a join to the encoding table)."""

    def __init__(self, state: dict | None = None, encoding_df: DataFrame | None = None):
        super().__init__()
        self.state = state or {}
        self.encoding_df = encoding_df

    # ---- feature expressions -------------------------------------------------
    def base_columns(self, df: DataFrame) -> list[tuple[str, Column]]:
        """First projection: every numeric value with codes nulled (``_c_*``) and then
        clipped and imputed (``_v_*``). Features refer to these columns, so each nested
        expression is generated once instead of once per feature that uses it."""
        s = self.state
        out = []
        for c in [c for c in s["numeric"] if c in df.columns]:
            codes = [C.SENTINEL] + ([C.SENTINEL_COLS[c]] if c in C.SENTINEL_COLS and C.SENTINEL_COLS[c] != C.SENTINEL else [])
            cleaned = X.null_if_sentinel(c, codes)
            lo, hi = s["bounds"][c]
            out.append((f"_c_{c}", cleaned))
            out.append((f"_v_{c}", F.coalesce(X.clip(cleaned, lo, hi), F.lit(float(s["fill"][c])))))
        return out

    def feature_columns(self, df: DataFrame, staged: bool = False) -> list[tuple[str, Column]]:
        s = self.state
        num = [c for c in s["numeric"] if c in df.columns]
        out: list[tuple[str, Column]] = []
        flags = s["flags"]
        # 1. code flags on raw values
        if flags:
            for c, code in C.SENTINEL_COLS.items():
                if c in df.columns:
                    out.append((f"{c}{C.SENTINEL_FLAG_SUFFIX}", X.sentinel_flag(c, code)))
        # 2. codes -> NULL (as columns of the first projection when staged)
        clean, v = {}, {}
        base = dict(self.base_columns(df))
        for c in num:
            clean[c] = F.col(f"_c_{c}") if staged else base[f"_c_{c}"]
            v[c] = F.col(f"_v_{c}") if staged else base[f"_v_{c}"]
        # 3. null flags
        if flags:
            for c in C.NULL_FLAG_COLS:
                if c in clean:
                    out.append((f"{c}{C.NULL_FLAG_SUFFIX}", X.null_flag(clean[c])))
        # 4-5. clip with TRAIN fences, then impute with TRAIN statistics (from unclipped values)
        for c in num:
            if c != "x8":
                out.append((c, v[c]))
        # 5b. logs
        for c in C.LOG_COLS:
            if c in v:
                out.append((f"{c}_log", X.log1p_pos(v[c])))
        # 5c. business features
        if flags and "x3" in v and "x4" in v:
            out.append(("n_productos_sin_registro", X.sentinel_flag("x3", C.SENTINEL) + X.sentinel_flag("x4", C.SENTINEL)))
        if "x3" in v and "x4" in v:
            out.append(("total_balance_log", X.log1p_pos(v["x3"] + v["x4"])))
            out.append(("x3_share", X.safe_share(v["x3"], v["x4"], 0.5)))
        score = None
        if "x7" in v and "x1" in v:
            score = X.log1p_pos(v["x7"]) * X.log1p_pos(v["x1"])
            out.append(("score_x_ingreso", score))
        if "x1" in v and "x10" in v:
            out.append(("x1_x_x10_log", X.log1p_pos(v["x1"]) * X.log1p_pos(v["x10"])))
        if "x1" in v and "x2" in v and s.get("ratio_cap") is not None:
            out.append(("ratio_x2_x1", X.capped_ratio(v["x2"], v["x1"], s["den_fill"], s["ratio_cap"])))
        if "x11" in v and "x12" in v:
            out.append(("x11_x12_sum", v["x11"] + v["x12"]))
        if flags and "x1" in clean and "x2" in clean:
            out.append(("co_missing_x1_x2", X.null_flag(clean["x1"]) * X.null_flag(clean["x2"])))
        if "x6" in v:
            if "x1" in v:
                out.append(("x6_x_x1_log", v["x6"] * X.log1p_pos(v["x1"])))
            if "x7" in v:
                out.append(("x6_x_x7", v["x6"] * v["x7"]))
            if score is not None:
                out.append(("x6_x_score_ingreso", v["x6"] * score))
        # 5d. bureau-score buckets, layout = sorted labels
        if "x7" in v:
            lab = X.bucket_label(X.clip(v["x7"], 0.0, 1000.0), C.X7_EDGES, X7_LABELS, X7_LABELS[0])
            for name in sorted(X7_LABELS):
                out.append((name, X.dummy(lab, name)))
        # 5e. ordinal one-hot with the TRAIN layout
        if "x8" in v:
            lv = X.ordinal_level(v["x8"], C.X8_LEVELS)
            for level in s["x8_levels"]:
                out.append((f"x8_cat_{level}", X.dummy(lv, level)))
        # 6. category
        cat = s["category"]
        if cat in df.columns:
            key = F.coalesce(F.col(cat), F.lit(C.UNKNOWN_CATEGORY))
            if s.get("top_levels") is not None:
                top = s["top_levels"]["top"]
                lv = F.when(key.isin(top), key).otherwise(F.lit(C.OTHER_CATEGORY))
                for level in s["top_levels"]["layout"]:
                    out.append((f"{cat}_{level}", X.dummy(lv, level)))
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        feats = self.feature_columns(df, staged=True)
        names = {n for n, _ in feats}
        drop = set(s["numeric"]) | {s["category"]}
        keep = [F.col(c) for c in df.columns if c not in drop and c not in names]
        staged = df.select("*", *[e.alias(n) for n, e in self.base_columns(df)])
        cat = s["category"]
        if self.encoding_df is not None and cat in df.columns:
            enc = self.encoding_df.select(F.col("level").alias("_lvl"), F.col("encoding").alias("_enc"))
            keyed = staged.withColumn("_lvl", F.coalesce(F.col(cat), F.lit(C.UNKNOWN_CATEGORY)))
            joined = keyed.join(enc, "_lvl", "left")  # AQE broadcasts it when small at run time
            feats = feats + [(f"{cat}_target_enc", F.coalesce(F.col("_enc"), F.lit(float(s["global_mean"]))))]
            return joined.select(*keep, *[c.alias(n) for n, c in feats])
        return staged.select(*keep, *[c.alias(n) for n, c in feats])

    def feature_names(self, df: DataFrame) -> list[str]:
        names = [n for n, _ in self.feature_columns(df)]
        if self.encoding_df is not None:
            names.append(f"{self.state['category']}_target_enc")
        return names

    # ---- S5 persistence ------------------------------------------------------
    def save_state(self, spark: SparkSession, path: str) -> None:
        save_params(spark, path, self.state | {"has_encoding": self.encoding_df is not None})
        if self.encoding_df is not None:
            self.encoding_df.write.mode("overwrite").parquet(path.rstrip("/") + "/encoding")

    @classmethod
    def load_state(cls, spark: SparkSession, path: str) -> "RiskPreprocessorModel":
        state = load_params(spark, path)
        state["bounds"] = {k: tuple(v) for k, v in state["bounds"].items()}
        # a model saved with its encoding must be read with it: a missing folder is an error, not a smaller model
        enc = spark.read.parquet(path.rstrip("/") + "/encoding") if state.pop("has_encoding") else None
        return cls(state=state, encoding_df=enc)


def target_encoding_table(df: DataFrame, category: str, label: str = C.TARGET, smoothing: float = 10.0, global_mean: float | None = None) -> DataFrame:
    """per level (NULL is its own level) n, mean target and (n * mean + k * global) / (n + k).

    One ``groupBy`` with partial aggregation; a level holding a third of the
    rows is still one partial row per task.
    """
    key = F.coalesce(F.col(category), F.lit(C.UNKNOWN_CATEGORY)).alias("level")
    g = F.lit(float(global_mean)) if global_mean is not None else F.col("_g")
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"))
    if global_mean is None:
        per = per.crossJoin(F.broadcast(df.agg(F.avg(label).alias("_g"))))
    k = F.lit(float(smoothing))
    return per.select("level", "n", "mean", ((F.col("n") * F.col("mean") + k * g) / (F.col("n") + k)).alias("encoding"))


def prepare_train_test(df: DataFrame, label: str = C.TARGET, split: str = C.SPLIT, id_col: str = C.ID, **params):
    """filter the splits, fit on TRAIN, transform both. Identity, split and target pass through."""
    train = df.where(F.col(split) == C.TRAIN)
    test = df.where(F.col(split) == C.TEST)
    model = RiskPreprocessor(labelCol=label, **params).fit(train)
    return model.transform(train), model.transform(test), model


def holdout_flag(id_col: str = C.ID, pct: int = 20, seed: int = 42) -> Column:
    """stable hold-out membership: pmod(xxhash64(id, seed), 100) < pct (same answer under any partitioning)."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(100)) < F.lit(pct)


def fold_column(id_col: str = C.ID, k: int = 3, seed: int = 42) -> Column:
    """stable k-fold assignment 0..k-1 from a seeded hash of the id."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.lit(k)).cast("int")


def portable_key(id_col: str = C.ID, seed: int = 42) -> Column:
    """A seeded key of a whole-number id in 0..2^32-1 that any SQL engine can state: (id mod 2^31) * 2654435761 + seed * 40503, mod 2^32.

    ``holdout_flag`` and ``fold_column`` hash with Spark's own function; splits that other
    systems must reproduce take this key instead (a multiplicative hash, then modulus).
    """
    return F.pmod(F.pmod(F.col(id_col), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed * 40503), F.lit(1 << 32))


def portable_holdout(id_col: str = C.ID, pct: int = 20, seed: int = 42) -> Column:
    """F11 by ``portable_key``: the lowest ``pct`` hundredths of the key range."""
    return F.col(id_col).isNotNull() & (F.coalesce(portable_key(id_col, seed), F.lit(1 << 32)) * F.lit(100) < F.lit(pct << 32))


def portable_fold(id_col: str = C.ID, k: int = 5, seed: int = 42) -> Column:
    """F12 by ``portable_key``: k equal stretches of the key range, 0..k-1."""
    return F.shiftright(portable_key(id_col, seed + 1) * F.lit(k), 32).cast("int")


def portable_sample(df: DataFrame, n: int, id_col: str = C.ID, seed: int = 42) -> DataFrame:
    """J7 by ``portable_key``: the ``n`` rows with the smallest keys (ties: smaller id)."""
    return df.orderBy(portable_key(id_col, seed), F.col(id_col)).limit(n)


def feature_list(model: RiskPreprocessorModel, df: DataFrame) -> list[str]:
    return model.feature_names(df)


def dummy_layout(levels: Sequence[str], prefix: str) -> list[str]:
    return [f"{prefix}_{lv}" for lv in sorted(levels)]
