"""Forecasters over history arrays, backtest and model choice.

Every forecaster is a column expression from (history array, horizon) to a
path array, so all series and all models run side by side in one narrow stage.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEASON = 12
MOVING_WINDOW = 3
# Smoothing weights tried for level, trend and season.
HOLT_WINTERS_GRID = tuple(product((0.25, 0.5, 0.75), (0.0625, 0.25), (0.125, 0.5)))
PHI_LIMIT = 0.98
PIVOT_LEAST = 1e-10  # share of a lag's spread that the earlier lags leave
MAX_HOLDOUT = 12
_EXACT = "decimal(38,4)"


def _steps(horizon: Column) -> Column:
    return F.when(horizon >= 1, F.sequence(F.lit(1), horizon)).otherwise(F.array().cast("array<int>"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("decimal(28,2)"), lambda a, v: (a + v).cast("decimal(28,2)"))


def moving_average_path(y: Column, n: Column, horizon: Column, window: int = MOVING_WINDOW) -> Column:
    """The mean of the last ``window`` months, flat."""
    used = F.least(F.lit(window), n)
    mean = _total(F.slice(y, n - used + 1, used)).cast("double") / used
    return F.transform(_steps(horizon), lambda j: mean)


def holt_winters_path(y: Column, n: Column, horizon: Column, grid=HOLT_WINTERS_GRID) -> Column:
    """Additive level, trend and, from two years on, season.

    The weights with the least squared one-step error win; ties go to the
    earlier grid entry. Without a season the ring is a single constant zero.
    """
    seasonal = n >= 2 * SEASON
    z = F.transform(y, lambda v: v.cast("double"))
    first_year = _total(F.slice(y, 1, SEASON)).cast("double")
    second_year = _total(F.slice(y, SEASON + 1, SEASON)).cast("double")
    flat_trend = F.when(n >= 2, F.get(z, F.lit(1)) - F.get(z, F.lit(0))).otherwise(F.lit(0.0))
    level0 = F.when(seasonal, first_year / F.lit(12.0)).otherwise(F.get(z, F.lit(0)))
    trend0 = F.when(seasonal, (second_year - first_year) / F.lit(144.0)).otherwise(flat_trend)
    ring0 = F.when(seasonal, F.transform(F.slice(z, 1, SEASON), lambda v: v - level0)).otherwise(F.array(F.lit(0.0)))
    start = F.when(seasonal, F.lit(SEASON)).otherwise(F.lit(1))
    rest = F.slice(z, start + 1, F.greatest(n - start, F.lit(0)))

    weights = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g"))
            for i, (a, b, g) in enumerate(grid)
        ]
    )

    def fold(w: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            season = F.get(acc["ring"], F.lit(0))
            base = acc["level"] + acc["trend"]
            error = v - (base + season)
            level = w["a"] * (v - season) + (F.lit(1.0) - w["a"]) * base
            trend = w["b"] * (level - acc["level"]) + (F.lit(1.0) - w["b"]) * acc["trend"]
            gamma = F.when(seasonal, w["g"]).otherwise(F.lit(0.0))
            renewed = gamma * (v - level) + (F.lit(1.0) - gamma) * season
            rotated = F.concat(F.slice(acc["ring"], 2, SEASON), F.array(renewed))
            return F.struct(
                (acc["sse"] + error * error).alias("sse"),
                w["i"].alias("i"),
                level.alias("level"),
                trend.alias("trend"),
                rotated.alias("ring"),
            )

        zero = F.struct(
            F.lit(0.0).alias("sse"), w["i"].alias("i"), level0.alias("level"), trend0.alias("trend"), ring0.alias("ring")
        )
        return F.aggregate(rest, zero, step)

    # One-element transform binds the winner, so the grid is folded only once.
    best = F.array(F.array_min(F.transform(weights, fold)))
    paths = F.transform(
        best,
        lambda b: F.transform(
            _steps(horizon),
            lambda j: b["level"] + j.cast("double") * b["trend"] + F.get(b["ring"], (j - 1) % F.size(b["ring"])),
        ),
    )
    return F.get(paths, F.lit(0))


def _differenced(y: Column, n: Column, d: int) -> Column:
    if d == 0:
        return y
    rest = F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(y, 2, rest), F.slice(y, 1, rest), lambda a, b: (a - b).cast("decimal(18,2)"))


def arima_path(y: Column, n: Column, horizon: Column, d: int) -> Column:
    """ARIMA(1,d,0), d in (0, 1), by conditional least squares.

    Sums are exact decimals; the slope is kept inside the stationary range.
    Fewer than two pairs give the last value, flat.
    """
    w = _differenced(y, n, d)
    pairs = F.greatest(n - d - 1, F.lit(0))
    both = F.zip_with(F.slice(w, 1, pairs), F.slice(w, 2, pairs), lambda a, b: F.struct(a.alias("x"), b.alias("t")))
    zero = F.lit(0).cast(_EXACT)
    sums = F.aggregate(
        both,
        F.struct(zero.alias("x"), zero.alias("t"), zero.alias("xx"), zero.alias("xt")),
        lambda s, p: F.struct(
            (s["x"] + p["x"]).cast(_EXACT).alias("x"),
            (s["t"] + p["t"]).cast(_EXACT).alias("t"),
            (s["xx"] + p["x"] * p["x"]).cast(_EXACT).alias("xx"),
            (s["xt"] + p["x"] * p["t"]).cast(_EXACT).alias("xt"),
        ),
        lambda s: F.struct(*[s[k].cast("double").alias(k) for k in ("x", "t", "xx", "xt")]),
    )
    m = pairs.cast("double")

    def slope(s: Column) -> Column:
        spread = m * s["xx"] - s["x"] * s["x"]
        raw = F.when(spread > 0, F.try_divide(m * s["xt"] - s["x"] * s["t"], spread)).otherwise(F.lit(0.0))
        return F.greatest(F.lit(-PHI_LIMIT), F.least(F.lit(PHI_LIMIT), raw))

    fitted = F.transform(F.array(sums), lambda s: F.struct(s.alias("s"), slope(s).alias("phi")))
    fitted = F.transform(
        fitted, lambda f: F.struct(f["phi"].alias("phi"), F.try_divide(f["s"]["t"] - f["phi"] * f["s"]["x"], m).alias("c"))
    )
    last_y = F.get(y, n - 1).cast("double")
    last_w = F.get(w, n - d - 1).cast("double")

    def walk(f: Column) -> Column:
        def step(acc: Column, _j: Column) -> Column:
            move = f["c"] + f["phi"] * acc["w"]
            value = acc["y"] + move if d == 1 else move
            return F.struct(move.alias("w"), value.alias("y"), F.concat(acc["path"], F.array(value)).alias("path"))

        start = F.struct(last_w.alias("w"), last_y.alias("y"), F.array().cast("array<double>").alias("path"))
        return F.aggregate(_steps(horizon), start, step, lambda acc: acc["path"])

    flat = F.transform(_steps(horizon), lambda j: last_y)
    return F.when(pairs >= 2, F.get(F.transform(fitted, walk), F.lit(0))).otherwise(flat)


# Candidates in the order that breaks ties.
CANDIDATES = {
    "arima_110": lambda y, n, h: arima_path(y, n, h, 1),
    "arima_100": lambda y, n, h: arima_path(y, n, h, 0),
    "holt_winters": holt_winters_path,
    "moving_average": moving_average_path,
}


def arima_lags_path(y: Column, n: Column, horizon: Column, p: int, d: int) -> Column:
    """ARIMA(p,d,0), d in (0, 1), by conditional least squares on ``p`` lags.

    The lags' Gram matrix is summed exactly, centred, and solved by symmetric
    elimination. A lag that the earlier ones explain (a pivot of at most
    ``PIVOT_LEAST`` of its spread) gets no weight. Series with fewer than
    ``2 * p + 1`` values after differencing give the last value, flat.
    """
    w = _differenced(y, n, d)
    m = F.greatest(n - d - p, F.lit(0))
    lagged = F.array(*[F.slice(w, p + 1 - i, m) for i in range(p + 1)])  # the values i months back
    count = m.cast("double")

    def exact(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast(_EXACT), lambda s, v: (s + v).cast(_EXACT), lambda s: s.cast("double"))

    def product(a: Column, b: Column) -> Column:
        return exact(F.zip_with(a, b, lambda u, v: u * v))

    def moments(lags: Column) -> Column:
        gram = F.transform(lags, lambda a: F.transform(lags, lambda b: product(a, b)))
        return F.struct(F.transform(lags, exact).alias("sums"), gram.alias("gram"))

    def equations(s: Column) -> Column:
        def entry(i: int, j: int) -> Column:
            return count * F.get(F.get(s["gram"], F.lit(i)), F.lit(j)) - F.get(s["sums"], F.lit(i)) * F.get(s["sums"], F.lit(j))

        rows = F.array(*[F.array(*[entry(i, j) for j in (*range(1, p + 1), 0)]) for i in range(1, p + 1)])
        return F.struct(s["sums"].alias("sums"), rows.alias("rows"))

    def solved(e: Column) -> Column:
        def eliminate(rows: Column, k: Column) -> Column:
            row = F.get(rows, k)
            pivot = F.get(row, k)
            clear = pivot > F.lit(PIVOT_LEAST) * F.get(F.get(e["rows"], k), k)

            def less(r: Column) -> Column:
                return F.zip_with(r, row, lambda a, b: a - F.get(r, k) / pivot * b)

            return F.transform(
                rows,
                lambda r, i: F.when((i == k) & ~clear, F.transform(r, lambda _: F.lit(0.0))).when((i == k) | ~clear, r).otherwise(less(r)),
            )

        done = F.aggregate(F.array(*[F.lit(k) for k in range(p)]), e["rows"], eliminate)
        phi = F.transform(done, lambda r, i: F.when(F.get(r, i) > 0, F.get(r, F.lit(p)) / F.get(r, i)).otherwise(F.lit(0.0)))
        return F.struct(e["sums"].alias("sums"), phi.alias("phi"))

    def weighted(start: Column, phi: Column, values: Column, sign: float) -> Column:
        terms = F.zip_with(phi, values, lambda f, v: F.struct(f.alias("f"), v.alias("v")))
        return F.aggregate(terms, start, lambda s, t: s + F.lit(sign) * (t["f"] * t["v"]))

    def intercept(f: Column) -> Column:
        rest = weighted(F.get(f["sums"], F.lit(0)), f["phi"], F.slice(f["sums"], 2, p), -1.0)
        return F.struct(f["phi"].alias("phi"), F.try_divide(rest, count).alias("c"))

    last_y = F.get(y, n - 1).cast("double")
    newest_first = F.array(*[F.get(w, n - d - i).cast("double") for i in range(1, p + 1)])

    def walk(f: Column) -> Column:
        def step(acc: Column, _j: Column) -> Column:
            # One-element transform binds the move, which is used three times.
            moved = F.transform(F.array(weighted(f["c"], f["phi"], acc["recent"], 1.0)), lambda move: F.struct(
                F.concat(F.array(move), F.slice(acc["recent"], 1, p - 1)).alias("recent"),
                (acc["y"] + move if d == 1 else move).alias("y"),
            ))
            return F.get(F.transform(moved, lambda a: F.struct(
                a["recent"].alias("recent"), a["y"].alias("y"), F.concat(acc["path"], F.array(a["y"])).alias("path")
            )), F.lit(0))

        start = F.struct(newest_first.alias("recent"), last_y.alias("y"), F.array().cast("array<double>").alias("path"))
        return F.aggregate(_steps(horizon), start, step, lambda acc: acc["path"])

    paths = F.array(lagged)
    for bind in (moments, equations, solved, intercept, walk):
        paths = F.transform(paths, bind)
    flat = F.transform(_steps(horizon), lambda j: last_y)
    return F.when(n - d >= 2 * p + 1, F.get(paths, F.lit(0))).otherwise(flat)


def forecast_arima(history: DataFrame, p: int = 1, d: int = 1) -> DataFrame:
    """ARIMA(p,d,0) paths for (series_key, y, n, horizon)."""
    if p < 1 or d not in (0, 1):
        raise ValueError("p must be at least 1 and d 0 or 1")
    y, n, horizon = F.col("y"), F.col("n"), F.col("horizon")
    path = arima_path(y, n, horizon, d) if p == 1 else arima_lags_path(y, n, horizon, p, d)
    return _steps_of(history.select("series_key", path.alias("path")))


def forecast_holt_winters(history: DataFrame) -> DataFrame:
    path = holt_winters_path(F.col("y"), F.col("n"), F.col("horizon"))
    return _steps_of(history.select("series_key", path.alias("path")))


def forecast_moving_average(history: DataFrame, window: int = MOVING_WINDOW) -> DataFrame:
    path = moving_average_path(F.col("y"), F.col("n"), F.col("horizon"), window)
    return _steps_of(history.select("series_key", path.alias("path")))


def _steps_of(paths: DataFrame) -> DataFrame:
    return paths.select("series_key", F.posexplode("path").alias("at", "value")).select(
        "series_key", (F.col("at") + 1).alias("step"), "value"
    )


def _all_paths(y: Column, n: Column, horizon: Column) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("model_rank"), F.lit(name).alias("model_name"), path(y, n, horizon).alias("path"))
            for i, (name, path) in enumerate(CANDIDATES.items())
        ]
    )


def backtest_mape(history: DataFrame) -> DataFrame:
    """Mean absolute percent error of each model on the held-out last months.

    Months with an actual of zero are left out; series too short to hold
    anything out have no rows. Terms are summed as fixed-point integers.
    """
    n, holdout = F.col("n"), F.least(F.lit(MAX_HOLDOUT), F.floor(F.col("n") / 5)).cast("int")
    split = history.withColumn("holdout", holdout).where(F.col("holdout") >= 1)
    known = n - F.col("holdout")
    paths = _all_paths(F.slice("y", F.lit(1), known), known, F.col("holdout"))
    scored = split.select(
        "series_key", F.slice("y", known + 1, F.col("holdout")).alias("actual"), F.explode(paths).alias("m")
    )
    terms = F.filter(
        F.zip_with(
            F.transform("actual", lambda a: a.cast("double")),
            F.col("m.path"),
            lambda a, f: F.when(a != 0, F.floor(F.abs(a - f) / F.abs(a) * F.lit(1e8) + F.lit(0.5)).cast("bigint")),
        ),
        lambda t: t.isNotNull(),
    )
    total = F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, t: a + t).cast("double")
    percent = F.try_divide(total, F.size(terms)) / F.lit(1e6)
    return scored.select(
        "series_key",
        F.col("m.model_rank").alias("model_rank"),
        F.col("m.model_name").alias("model_name"),
        (F.floor(percent * 100 + F.lit(0.5)).cast("double") / F.lit(100.0)).alias("mape"),
    )


def select_forecast_model(scores: DataFrame) -> DataFrame:
    """The model of least error per series; ties go to the fixed model order."""
    order = W.partitionBy("series_key").orderBy(F.col("mape").asc_nulls_last(), "model_rank")
    best = scores.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == 1)
    return best.select("series_key", "model_name", "mape")


def chosen_paths(history: DataFrame, chosen: DataFrame) -> DataFrame:
    """Refit on the whole history and keep the chosen model's path."""
    paths = _all_paths(F.col("y"), F.col("n"), F.col("horizon"))
    return history.join(chosen, "series_key").select(
        "series_key",
        "months",
        "y",
        "model_name",
        "mape",
        F.get(F.filter(paths, lambda m: m["model_name"] == F.col("model_name")), F.lit(0))["path"].alias("path"),
    )
