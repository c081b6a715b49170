"""Catalog: training sets, split, regressors, comparison, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import fixed4
from ledgerloom.operators import boosting as bo
from ledgerloom.operators import evaluation as ev
from ledgerloom.operators import features as ft
from ledgerloom.operators import kernels as kn
from ledgerloom.operators import neighbours as nb
from ledgerloom.operators import regressors as rg
from ledgerloom.plans import training as tr
from ledgerloom.plans.catalog.inputs import sales_table, sql_fixed4, sql_mean, stored_sales, with_sales
from ledgerloom.session import materialise, scratch_path

_TIERS = {"region": ("region",), "product": ("category", "sub_category"), "segment": ("category", "sub_category", "region")}


def _rows(spark, folder, task: ft.Task) -> DataFrame:
    """The task's training set, written once: fits pass over it many times."""
    return materialise(ft.training_set(sales_table(spark, folder), task))


def demand_training_set(spark, folder):
    return ft.demand_training_set(sales_table(spark, folder))


def sales_training_set(spark, folder):
    return ft.sales_training_set(sales_table(spark, folder))


def train_test_split(spark, folder):
    return ft.with_split(sales_table(spark, folder)).select("row_key", "in_test")


def feature_pipeline(spark, folder):
    """Vector positions set to one and the vector's sum, per order line."""
    rows = _rows(spark, folder, ft.SALES)
    vectors = ft.vectorised(ft.feature_pipeline(ft.SALES.cats, ()).fit(rows), rows)
    marks = F.transform(vector_to_array("features"), lambda v, i: F.when(v != 0, i))
    return vectors.select(
        "row_key",
        F.concat_ws(",", F.transform(F.array_compact(marks), lambda i: i.cast("string"))).alias("positions"),
        F.size(marks).alias("width"),
    )


def error_metrics(spark, folder):
    """Test rows predicted by the mean sales of their region, product and segment."""
    return _mean_scores(spark, folder).select("task", "model", "mae", "rmse", "r2")


def _mean_scores(spark, folder) -> DataFrame:
    """Metrics of three plain mean predictors on two labels."""
    sales = stored_sales(spark, folder)
    train, test = ft.train_test_split(sales)
    parts = []
    for task, label in (("sales", "sales"), ("quantity", "quantity")):
        for i, (name, keys) in enumerate(_TIERS.items()):
            means = train.groupBy(*keys).agg((F.sum(label).cast("double") / F.count(label)).alias("prediction"))
            scored = test.withColumn("label", F.col(label).cast("double")).join(means, list(keys))
            metrics = ev.error_metrics(scored)
            parts.append(
                metrics.select(
                    F.lit(task).alias("task"), F.lit(name).alias("model"), F.lit(i).alias("ordinal"),
                    *[fixed4(c).alias(c) for c in ("mae", "rmse", "r2")],
                )
            )
    return reduce(DataFrame.unionByName, parts)


def best_model(spark, folder):
    return ev.best_model(_mean_scores(spark, folder)).drop("ordinal")


def comparison_pick(spark, folder):
    return ev.comparison_pick(_mean_scores(spark, folder))


def knn_join(spark, folder):
    train, test = ft.train_test_split(_rows(spark, folder, ft.SALES))
    return nb.knn_join(test, train, rg.NEIGHBOURS, ft.SALES.cats, ft.SALES.nums)


def _predictions(spark, folder, name: str, task: ft.Task = ft.SALES) -> DataFrame:
    train, test = ft.train_test_split(_rows(spark, folder, task))
    model = tr.fit_model(train, task, name)
    return _judged(model.predict(test), train)


def _judged(scored: DataFrame, train: DataFrame) -> DataFrame:
    """row_key, label, prediction, and what holds for any regressor that learned something.

    ``inside``: the prediction lies in the training labels' range, widened by
    half of it for models that extrapolate. ``skilled``: over all rows the
    squared error is below that of the training mean.
    """
    seen = train.agg(F.min("label").alias("low"), F.max("label").alias("high"), F.avg("label").alias("mean")).first()
    room = 0.5 * (seen["high"] - seen["low"])
    scored = materialise(scored.select("row_key", "label", "prediction"))
    gain = scored.agg(F.sum((F.col("label") - seen["mean"]) ** 2 - (F.col("label") - F.col("prediction")) ** 2)).scalar()
    return scored.withColumns({
        "inside": F.col("prediction").between(seen["low"] - room, seen["high"] + room), "skilled": gain > 0,
    })


def _model_query(name: str):
    def query(spark, folder):
        return _predictions(spark, folder, name).drop("prediction")

    query.__name__ = f"model_{name}"
    return query


def model_random_cut_forest(spark, folder):
    """Training rows. Every tree has all of them and is grown to the end, so a
    row's prediction is the mean label of the rows with its features."""
    train, _ = ft.train_test_split(_rows(spark, folder, ft.SALES))
    model = tr.fit_model(train, ft.SALES, "random_cut_forest")
    return model.predict(train).select("row_key", "label", fixed4("prediction").alias("prediction"))


def model_rbf_svr(spark, folder):
    """As the others, and ``certified``: over the training rows the objective, calculated again from
    the predictions and the landmarks' kernel, lies within the bound above a point of the dual."""
    train, test = ft.train_test_split(_rows(spark, folder, ft.SALES))
    model = tr.fit_model(train, ft.SALES, "rbf_svr")
    core = model.core
    over = F.greatest(F.lit(0.0), F.abs(F.col("label") - F.col("prediction")) - kn.EPSILON)
    missed = model.predict(train).agg(F.sum(over)).first()[0]
    norm = core.weights @ kn.gaussian(core.landmarks, core.landmarks, core.gamma) @ core.weights
    again = 0.5 * norm + rg.SVR_C * missed
    certified = again - (core.objective - core.gap) <= 1.01 * kn.GAP * again
    return _judged(model.predict(test), train).drop("prediction").withColumn("certified", F.lit(bool(certified)))


LEAF_SLACK = 1e-6


def model_gbt(spark, folder):
    """As the others, and ``certified``: in every round each leaf of the tree answers with the mean, over
    its training rows, of what the rounds before left of their labels."""
    train, test = ft.train_test_split(_rows(spark, folder, ft.SALES))
    model = tr.fit_model(train, ft.SALES, "gbt")
    each = train.select("label", F.posexplode(model.core.stages()).alias("turn", "e")).select("turn", "label", "e.*")
    leaves = each.groupBy("turn", "value").agg(F.avg(F.col("label") - F.col("before")).alias("mean"))
    size = train.agg(F.stddev_pop("label")).first()[0]
    right = F.abs(F.col("mean") - F.col("value")) <= LEAF_SLACK * size
    seen = leaves.agg(F.min(right).alias("right"), F.countDistinct("turn").alias("turns"), F.count("value").alias("leaves")).first()
    rounds = rg.FULL["sales"].boost_rounds
    certified = seen["right"] and seen["turns"] == rounds and seen["leaves"] > rounds
    return _judged(model.predict(test), train).drop("prediction").withColumn("certified", F.lit(bool(certified)))


def gbt_first_tree(spark, folder):
    """The first tree's answer for each training row."""
    train, _ = ft.train_test_split(_rows(spark, folder, ft.SALES))
    model = bo.fit_gradient(train, ft.SALES.cats, ft.SALES.nums, 1, rg.BOOST_DEPTH, rg.BOOST_RATE)
    return train.select("row_key", fixed4(model.stages()[0]["value"]).alias("value"))


LINEAR = ("linear", "ridge", "lasso", "elastic_net")
OWN = ("knn", "random_cut_forest", "rbf_svr", "gbt")
GRADIENT_SLACK = 1e-3


def _linear_query(name: str):
    """Per feature, whether the fit on the training rows meets its optimality condition.

    With residuals r = label - prediction, the penalised loss is least where
    sum(r x) equals l2 * w, up to n * l1 for the absolute penalty. The slack is
    relative to sum(abs(label x)).
    """

    def query(spark, folder):
        train, _ = ft.train_test_split(_rows(spark, folder, ft.SALES))
        model = tr.fit_model(train, ft.SALES, name)
        scored = materialise(model.predict(train).withColumn("r", F.col("label") - F.col("prediction")))
        weights = model.core.model.stages[0].coefficients.toArray()
        n = scored.count()
        l1 = {"lasso": rg.ALPHA, "elastic_net": rg.ALPHA * rg.L1_RATIO}.get(name, 0.0) * n
        l2 = {"ridge": rg.ALPHA, "elastic_net": rg.ALPHA * (1 - rg.L1_RATIO) * n}.get(name, 0.0)
        parts = [
            scored.groupBy(F.concat(F.lit(f"{c}="), F.col(c)).alias("feature")).agg(
                F.sum("r").alias("g"), F.sum(F.abs("label")).alias("size")
            )
            for c in ft.SALES.cats
        ]
        sums = scored.agg(*[F.struct(F.sum(F.col("r") * F.col(c)).alias("g"), F.sum(F.abs(F.col("label") * F.col(c))).alias("size")).alias(c) for c in ft.SALES.nums])
        parts.append(sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), f"{c}.g", f"{c}.size") for c in ft.SALES.nums])).alias("e")).select("e.*"))
        gradients = reduce(DataFrame.unionByName, parts)
        # Vector order: the sorted values of each category column, then the numbers.
        indexer = model.prepared.stages[0]
        names = [f"{c}={v}" for c, values in zip(ft.SALES.cats, indexer.labelsArray, strict=True) for v in values] + list(ft.SALES.nums)
        known = spark.createDataFrame(list(zip(names, map(float, weights), strict=True)), "feature string, w double")
        excess = F.abs(F.col("g") - F.lit(l2) * F.col("w")) - F.lit(l1)
        return gradients.join(known, "feature").select("feature", (excess <= GRADIENT_SLACK * F.col("size")).alias("optimal"))

    query.__name__ = f"model_{name}"
    return query


def model_knn(spark, folder):
    """Mean label of the seven nearest, averaged exactly for the comparison."""
    near = knn_join(spark, folder)
    exact = F.sum(F.col("label").cast("decimal(18,4)")).cast("double") / F.count("label")
    return near.groupBy("row_key").agg(exact.alias("prediction"))


def model_knn_demand(spark, folder):
    return _predictions(spark, folder, "knn", ft.DEMAND).select("row_key", "label", fixed4("prediction").alias("prediction"))


def fit_candidates(spark, folder):
    train, test = ft.train_test_split(_rows(spark, folder, ft.DEMAND))
    return _sound(tr.fit_candidates(train, test, ft.DEMAND)[1])


def _sound(results: DataFrame) -> DataFrame:
    """task, model, and whether its metrics fit together and beat the mean."""
    sound = (F.col("mae") > 0) & (F.col("mae") <= F.col("rmse")) & (F.col("r2") > 0) & (F.col("r2") <= 1)
    return results.select("task", "model", sound.alias("sound"))


def model_comparison(spark, folder):
    train, test = ft.train_test_split(_rows(spark, folder, ft.SALES))
    table = materialise(tr.model_comparison(tr.fit_candidates(train, test, ft.SALES)[1]))
    worse = table.select(F.col("place").alias("p"), F.col("mae").alias("m"))
    ordered = table.join(F.broadcast(worse), F.col("p") == F.col("place") - 1, "left")
    return _sound(table).join(
        ordered.select("model", "place", (F.col("m").isNull() | (F.col("m") <= F.col("mae"))).alias("ordered")), "model"
    ).select("task", "model", "sound", "ordered", (F.col("place").between(1, len(rg.CANDIDATES))).alias("placed"))


def refit_best(spark, folder):
    """The winner among all ten, refitted on all cells, predicting them."""
    rows = _rows(spark, folder, ft.DEMAND)
    model, _ = tr.refit_best(rows, ft.DEMAND)
    return _judged(model.predict(rows), rows).drop("prediction")


def write_comparison(spark, folder):
    path = scratch_path(spark, "comparison")
    tr.write_comparison(_mean_scores(spark, folder).where(F.col("task") == "sales"), path)
    return spark.read.schema("Model string, MAE double, RMSE double, R2 double").option("header", True).csv(path)


def save_load_model(spark, folder):
    """Predictions of a model before it was saved and after it was loaded."""
    rows = _rows(spark, folder, ft.DEMAND)
    model = tr.fit_model(rows, ft.DEMAND, "gbt")
    path = scratch_path(spark, "model")
    model.save(path)
    loaded = tr.TaskModel.load(spark, path)
    before = model.predict(rows).select("row_key", F.col("prediction").alias("before"))
    both = before.join(loaded.predict(rows).select("row_key", F.col("prediction").alias("after")), "row_key")
    return both.select("row_key", (F.col("before") == F.col("after")).alias("same"))


QUERIES = {
    f.__name__: f
    for f in (
        demand_training_set, sales_training_set, train_test_split, feature_pipeline, error_metrics, best_model,
        comparison_pick, write_comparison, knn_join, model_knn, model_knn_demand,
        *[(_linear_query if name in LINEAR else _model_query)(name) for name in (*rg.CANDIDATES, *rg.EXTRAS) if name not in OWN],
        model_random_cut_forest, model_rbf_svr, model_gbt, gbt_first_tree,
        fit_candidates, model_comparison, refit_best, save_load_model,
    )
}

_CATS, _NUMS = ft.SALES.cats, ft.SALES.nums
_IN_TEST = "cast('0x' || substr(md5(row_key), 1, 8) as bigint) % 10 < 2"
LINES_SQL = f"""lines as (
  select row_key, {", ".join(_CATS)}, {", ".join(f"cast({c} as double) as {c}" for c in _NUMS)},
         cast(sales as double) as label, {_IN_TEST} as in_test
  from sales
)"""


def _known(columns) -> str:
    return ", ".join(f"{c} in (select {c} from refs) as {c}_known" for c in columns)


def _neighbours_sql(source: str, cats, nums) -> str:
    gaps = " + ".join(f"(p.{c} - r.{c}) * (p.{c} - r.{c})" for c in nums)
    gaps += "".join(
        f" + case when p.{c}_known then case when p.{c} <> r.{c} then 2e0 else 0e0 end else 1e0 end" for c in cats
    )
    return f"""refs as materialized (
  select *, row_number() over (order by row_key) as place_by_key from {source} where not in_test
), probes as materialized (
  select *, {_known(cats)} from {source} where in_test
), near as (
  select p.row_key, min(struct_pack(d := {gaps}, k := r.place_by_key), {rg.NEIGHBOURS}) as best
  from probes p, refs r group by p.row_key
), placed as (
  select row_key, unnest(best) as n, cast(generate_subscripts(best, 1) as int) as place from near
), neighbours as (
  select p.row_key, p.place, r.row_key as ref_key, p.n.d as distance_sq, r.label
  from placed p join refs r on r.place_by_key = p.n.k
)"""


NEIGHBOURS_SQL = _neighbours_sql("lines", _CATS, _NUMS)


def _mean_sql(task: str, label: str, ordinal: int, name: str, keys) -> str:
    listed = ", ".join(keys)
    return f"""select '{task}' as task, '{name}' as model, {ordinal} as ordinal,
      {sql_fixed4('avg(abs(p - y))')} as mae, {sql_fixed4('sqrt(avg((p - y) * (p - y)))')} as rmse,
      {sql_fixed4('1e0 - sum((p - y) * (p - y)) / (var_pop(y) * count(*))')} as r2
      from (select cast({label} as double) as y, m.p from marked t
            join (select {listed}, {sql_mean(label)} as p from marked where not in_test group by {listed}) m using ({listed})
            where t.in_test)"""


SCORES_SQL = f"""marked as (
  select *, {_IN_TEST} as in_test from sales
), scores as (
  {" union all ".join(
      _mean_sql(task, label, i, name, keys)
      for task, label in (("sales", "sales"), ("quantity", "quantity"))
      for i, (name, keys) in enumerate(_TIERS.items()))}
)"""
CELL_SET_SQL = f"""cell_set as (
  select concat_ws('|', order_year, order_month, category, sub_category, region) as row_key, category, sub_category, region,
         cast(order_year as double) as order_year, cast(order_month as double) as order_month,
         {sql_mean('unit_price')} as avg_unit_price, {sql_mean('discount')} as avg_discount,
         cast(count(quantity) as double) as orders_count, cast(sum(quantity) as double) as label
  from sales group by order_year, order_month, category, sub_category, region
), split_cells as (select *, {_IN_TEST} as in_test from cell_set)"""
_FEATURES = " union all ".join(
    [f"select distinct '{c}=' || {c} as feature, true as optimal from lines where not in_test" for c in _CATS]
    + [f"select '{c}', true" for c in _NUMS]
)
_MODELS = ", ".join(f"'{name}'" for name in rg.CANDIDATES)
_BEST = "qualify row_number() over (partition by task order by mae, rmse, ordinal) = 1"


def _positions() -> str:
    parts, offset = [], "0"
    for c in _CATS:
        parts.append(f"cast((select count(distinct x.{c}) from lines x where x.{c} < l.{c}) + {offset} as varchar)")
        offset += f" + (select count(distinct {c}) from lines)"
    return f"select row_key, concat_ws(',', {', '.join(parts)}) as positions, cast({offset} as int) as width from lines l"


def _first_tree_sql() -> str:
    """Every cut of every node weighed, level by level; a category's values stand in the order of their means."""
    values = " union all ".join(
        [f"select row_key, {i} as f, {c} as k, cast(null as double) as x from lines where not in_test" for i, c in enumerate(_CATS)]
        + [f"select row_key, {i} as f, cast({c} as varchar) as k, {c} as x from lines where not in_test" for i, c in enumerate(_NUMS, len(_CATS))]
    )
    parts = [f"""feature_values as materialized ({values}), nodes_0 as materialized (
  select row_key, 1 as node, label - (select avg(label) from lines where not in_test) as r from lines where not in_test
)"""]
    for d in range(rg.BOOST_DEPTH):
        parts.append(f"""means_{d} as (select node, count(*) as n, avg(r) as m from nodes_{d} group by node
), runs_{d} as (
  select node, f, k, any_value(x) as x, count(*) as w, sum(r - m) as s
  from nodes_{d} join means_{d} using (node) join feature_values using (row_key) group by node, f, k
), prefixes_{d} as materialized (
  select node, f, k, row_number() over upto as place, sum(w) over upto as w, sum(s) over upto as s
  from runs_{d} window upto as (partition by node, f order by coalesce(x, s / w), k rows unbounded preceding)
), best_{d} as materialized (
  select node, f, place from prefixes_{d} p join means_{d} using (node) where p.w < n
  qualify row_number() over (partition by node order by s * s / p.w + s * s / (n - p.w) desc, f, place) = 1
), lefts_{d} as (
  select p.node, p.f, p.k from prefixes_{d} p join best_{d} b on p.node = b.node and p.f = b.f and p.place <= b.place
), nodes_{d + 1} as materialized (
  select n.row_key, n.r, 2 * n.node + case when l.k is null then 1 else 0 end as node
  from nodes_{d} n left join best_{d} b on n.node = b.node
  left join feature_values v on v.row_key = n.row_key and v.f = b.f
  left join lefts_{d} l on l.node = n.node and l.f = v.f and l.k = v.k
)""")
    return ", ".join(parts)


ORACLES = {
    "demand_training_set": with_sales(
        f"""select concat_ws('|', order_year, order_month, category, sub_category, region) as row_key, category, sub_category, region,
            cast(order_year as double) as order_year, cast(order_month as double) as order_month,
            {sql_mean('unit_price')} as avg_unit_price, {sql_mean('discount')} as avg_discount,
            cast(count(quantity) as double) as orders_count, cast(sum(quantity) as double) as label
            from sales group by order_year, order_month, category, sub_category, region"""
    ),
    "sales_training_set": with_sales(LINES_SQL, "select * exclude (in_test) from lines"),
    "train_test_split": with_sales(f"select row_key, {_IN_TEST} as in_test from sales"),
    "feature_pipeline": with_sales(LINES_SQL, _positions()),
    "error_metrics": with_sales(SCORES_SQL, "select task, model, mae, rmse, r2 from scores"),
    "best_model": with_sales(SCORES_SQL, f"select task, model, mae, rmse, r2 from scores {_BEST}"),
    "comparison_pick": with_sales(SCORES_SQL, f"select task, model from scores {_BEST}"),
    "write_comparison": with_sales(
        SCORES_SQL, "select model as \"Model\", mae as \"MAE\", rmse as \"RMSE\", r2 as \"R2\" from scores where task = 'sales'"
    ),
    **{f"model_{name}": with_sales(LINES_SQL, _FEATURES) for name in LINEAR},
    **{
        f"model_{name}": with_sales(LINES_SQL, "select row_key, label, true as inside, true as skilled from lines where in_test")
        for name in (*rg.CANDIDATES, *rg.EXTRAS)
        if name not in (*LINEAR, *OWN)
    },
    "model_rbf_svr": with_sales(
        LINES_SQL, "select row_key, label, true as inside, true as skilled, true as certified from lines where in_test"
    ),
    "model_gbt": with_sales(
        LINES_SQL, "select row_key, label, true as inside, true as skilled, true as certified from lines where in_test"
    ),
    "gbt_first_tree": with_sales(
        LINES_SQL, _first_tree_sql(),
        f"select row_key, {sql_fixed4('avg(r) over (partition by node)')} as value from nodes_{rg.BOOST_DEPTH}",
    ),
    "model_random_cut_forest": with_sales(
        LINES_SQL,
        f"""select row_key, label, {sql_fixed4(f"avg(label) over (partition by {', '.join((*_CATS, *_NUMS))})")} as prediction
           from lines where not in_test""",
    ),
    "fit_candidates": f"select 'demand' as task, unnest([{_MODELS}]) as model, true as sound",
    "model_comparison": f"select 'sales' as task, unnest([{_MODELS}]) as model, true as sound, true as ordered, true as placed",
    "refit_best": with_sales(CELL_SET_SQL, "select row_key, label, true as inside, true as skilled from cell_set"),
    "save_load_model": with_sales(CELL_SET_SQL, "select row_key, true as same from cell_set"),
    "model_knn_demand": with_sales(
        CELL_SET_SQL,
        _neighbours_sql("split_cells", ft.DEMAND.cats, ft.DEMAND.nums),
        f"""select n.row_key, any_value(c.label) as label, {sql_fixed4('avg(n.label)')} as prediction
           from neighbours n join split_cells c using (row_key) group by n.row_key""",
    ),
    "knn_join": with_sales(LINES_SQL, NEIGHBOURS_SQL, "select * from neighbours"),
    "model_knn": with_sales(
        LINES_SQL,
        NEIGHBOURS_SQL,
        """select row_key, cast(sum(cast(label as decimal(18,4))) as double) / count(*) as prediction
           from neighbours group by row_key""",
    ),
}
