"""Every runnable query over the Parquet tables of a folder, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.churn import evaluate, features, model, nodes, split
from martlens.operators import cube, customers, dashboard, measures, products, quality, revenue
from martlens.session import drops, file_stamps, tune, written
from martlens.sources.tables import RetailTables, check_order_ids
from martlens.sources.tpch import retail_views

AS_OF = "2001-08-01"  # last order date of the sample tables
CATEGORY = "ECONOMY"
YEAR = 1997
REGION = "ASIA"
MONTHS = [f"{YEAR}-{month:02}" for month in range(1, 13)]

Query = Callable[[SparkSession, str], DataFrame]


def deterministic_scores(t: RetailTables) -> DataFrame:
    """Label and a score that only depends on recency, in place of a forest."""
    labels = features.churn_labels(t, AS_OF)
    score = F.least(F.col("recency").cast("double") / F.lit(730.0), F.lit(1.0))
    return labels.select("customer_id", "churned", score.alias("score"))


def _matrix(t: RetailTables) -> DataFrame:
    return features.feature_matrix(t, AS_OF)


class _Fit:
    """One fit of the forest, and what the queries publish of it, each written once."""

    def __init__(self, t: RetailTables) -> None:
        self.matrix = _matrix(t)
        self.model, self.tested = model.train_and_score(self.matrix)

    @cached_property
    def scored(self) -> DataFrame:
        return written(model.score(self.model, self.matrix))

    @cached_property
    def importances(self) -> DataFrame:
        return model.importances(self.model, self.matrix)

    def metrics(self) -> DataFrame:
        area = evaluate.roc_auc(self.tested).select("auc").scalar()
        return evaluate.classification_report(self.tested).withColumn("auc", area)

    def predictions(self) -> DataFrame:
        return evaluate.risk_bands(self.scored)

    def predictions_check(self) -> DataFrame:
        """Customers scored, and how many of them break a property of predictions."""
        return evaluate.predictions_check(self.predictions(), self.matrix)

    def importances_check(self) -> DataFrame:
        return model.importances_check(self.importances)

    def support(self) -> DataFrame:
        return evaluate.classification_report(self.tested).select("class", "support")

    def nodes_check(self) -> DataFrame:
        found = nodes.forest_nodes(self.matrix.sparkSession, self.model)
        return nodes.nodes_check(found, self.scored, self.importances, self.matrix)


def _label_rows(t: RetailTables) -> DataFrame:
    """Label and id of the matrix rows, without coding any category."""
    return features.matrix_rows(t, AS_OF).select("churned", "customer_id")


def _executive_slice(t: RetailTables) -> dict:
    return dashboard.executive_page(t, AS_OF, year=YEAR, region=REGION, category=CATEGORY)


def _customer_360(t: RetailTables) -> DataFrame:
    bands = evaluate.risk_bands(deterministic_scores(t))
    return customers.customer_360(t, AS_OF, bands)


# Reports that are read from the cube as well as from the orders.
CUBE_REPORTS = (
    "monthly_revenue_trend", "yearly_revenue", "kpi_summary", "payment_preference", "revenue_by_region",
    "revenue_by_tier", "order_status_breakdown", "shipping_by_region", "shipping_trend",
    "revenue_mom_growth", "measures_core", "measures_churn", "measures_returns",
    "measures_by_region_slicer", "top_region_kpis", "clv_top20", "rfm_base", "churn_by_region_tier",
    "churned_customers", "category_mix", "top_products", "category_month_revenue",
)

_QUERIES: dict[str, Callable[[RetailTables], DataFrame]] = {
    # Revenue, customers, products, operations
    "monthly_revenue_trend": revenue.monthly_revenue_trend,
    "yearly_revenue": revenue.yearly_revenue,
    "revenue_by_month": dashboard.revenue_by_month,
    "revenue_by_category": products.revenue_by_category,
    "payment_volume": dashboard.payment_volume,
    "kpi_summary": revenue.kpi_summary,
    "clv_top20": customers.clv,
    "rfm_base": lambda t: customers.rfm_base(t, AS_OF),
    "rfm_segments": lambda t: customers.rfm_segments(t, AS_OF),
    "rfm_histogram": lambda t: customers.rfm_histogram(t, AS_OF),
    "rfm_medians": lambda t: customers.rfm_medians(t, AS_OF),
    "churn_by_region_tier": lambda t: customers.churn_by_region_tier(t, AS_OF),
    "churn_by_region": lambda t: customers.churn_by_region(t, AS_OF),
    "top_products": products.product_revenue,
    "category_mix": products.category_mix,
    "low_stock_alert": products.low_stock,
    "revenue_by_region": revenue.revenue_by_region,
    "payment_preference": revenue.payment_preference,
    "order_status_breakdown": revenue.order_status_breakdown,
    "status_share": revenue.status_share,
    "shipping_by_region": revenue.shipping_by_region,
    # Measures and dashboard visuals
    "measures_core": lambda t: measures.measures(t, measures.CORE),
    "measures_churn": lambda t: measures.measures(t, measures.CHURN, as_of=AS_OF),
    "measures_profit": lambda t: measures.measures(t, measures.PROFIT),
    "measures_returns": lambda t: measures.measures(t, measures.RETURNS),
    "measures_sliced": lambda t: measures.measures(
        t,
        ("total_revenue", "total_orders", "avg_order_value", "unique_customers",
         "gross_profit", "profit_margin_pct", "return_rate_pct"),
        by=["region", "month"],
        year=YEAR,
        category=CATEGORY,
    ),
    "measures_by_region_slicer": lambda t: measures.measures(
        t, measures.CORE + ("return_rate_pct",), by=["year"], region=REGION
    ),
    "executive_sliced_by_month": lambda t: _executive_slice(t)["revenue_by_month"](),
    "executive_sliced_status": lambda t: _executive_slice(t)["orders_by_status"](),
    "churn_measure_by_region": lambda t: measures.measures(
        t, measures.CHURN, by=["region"], as_of=AS_OF
    ),
    "revenue_mom_growth": revenue.revenue_mom_growth,
    "revenue_by_tier": revenue.revenue_by_tier,
    "customer_360": _customer_360,
    "category_product_rollup": products.category_product_rollup,
    "category_month_revenue": products.category_month_revenue,
    "category_month_matrix": lambda t: products.category_month_revenue(
        t, wide=True, months=MONTHS
    ),
    "avg_discount": products.avg_discount,
    "shipping_trend": revenue.shipping_trend,
    "low_stock_strict": lambda t: products.low_stock(t, inclusive=False),
    "churned_customers": lambda t: customers.churned_customers(t, AS_OF),
    "top_region_kpis": measures.top_region_kpis,
    "category_product_detail": lambda t: products.category_product_detail(t, CATEGORY),
    "purchase_history": customers.purchase_history,
    # Keys and money rules
    "dq_duplicate_keys": quality.duplicate_keys,
    "dq_orphan_keys": quality.orphan_keys,
    "star_view_counts": quality.star_view_counts,
    "derived_line_totals": quality.derived_line_totals,
    "order_total_reconciliation": quality.order_total_reconciliation,
    # Churn features and labels
    "churn_features": lambda t: features.churn_features(t, AS_OF),
    "churn_features_order_grain": lambda t: features.churn_features(t, AS_OF, "order"),
    "churn_labels": lambda t: features.churn_labels(t, AS_OF),
    "encoded_categories": features.encoded_categories,
    "feature_matrix": _matrix,
    "churn_dataset_summary": lambda t: features.churn_dataset_summary(_label_rows(t)),
    "stratified_split_counts": lambda t: split.stratified_split_counts(written(_label_rows(t))),
    "cv_folds": lambda t: split.fold_counts(written(_label_rows(t))),
    "class_weights": lambda t: split.balanced_weights(_label_rows(t)),
    # Evaluation on the deterministic score
    "classification_report": lambda t: evaluate.classification_report(
        deterministic_scores(t)
    ),
    "confusion_matrix": lambda t: evaluate.confusion_matrix(deterministic_scores(t)),
    "roc_auc": lambda t: evaluate.roc_auc(deterministic_scores(t)),
    "roc_curve": lambda t: evaluate.roc_curve(deterministic_scores(t)),
    "churn_risk_bands": lambda t: evaluate.risk_bands(deterministic_scores(t)),
    "risk_band_counts": lambda t: evaluate.risk_band_counts(
        evaluate.risk_bands(deterministic_scores(t))
    ),
    "cv_auc": lambda t: model.cv_auc(_matrix(t)),
}

_CUBE_QUERIES = {f"cube_{name}": _QUERIES[name] for name in CUBE_REPORTS}
# Built anew each time; all other queries of the cube share one for the same files.
_QUERIES["order_cube"] = lambda t: cube.cell_sums(cube.build(t))


# Published figures of the forest, fitted anew for each.
_FIT_QUERIES: dict[str, Callable[[_Fit], DataFrame]] = {
    "rf_train_metrics": _Fit.metrics,
    "feature_importance": lambda fit: fit.importances,
    "churn_predictions": _Fit.predictions,
}
# Checks of the forest that was published last for the same files.
_FIT_CHECKS: dict[str, Callable[[_Fit], DataFrame]] = {
    "churn_predictions_check": _Fit.predictions_check,
    "feature_importance_check": _Fit.importances_check,
    "rf_support": _Fit.support,
    "forest_nodes_check": _Fit.nodes_check,
}


def open_tables(spark: SparkSession, folder: str) -> RetailTables:
    """The tables of a folder.

    Whether order ids are unique is remembered for exactly the files that were
    checked, as listed by the folder's own file system; when a file is added,
    replaced or removed, the answer is looked for again.
    """
    return retail_views(tune(spark), folder, _remembered(spark, folder))


_CHECKED: dict[tuple, bool] = {}


def _remembered(spark: SparkSession, folder: str) -> Callable[[DataFrame], bool]:
    def check(orders: DataFrame) -> bool:
        key = (spark.sparkContext.applicationId, file_stamps(spark, f"{folder}/orders.parquet"))
        if key not in _CHECKED:
            if len(_CHECKED) >= 64:
                _CHECKED.clear()
            _CHECKED[key] = check_order_ids(orders)
        return _CHECKED[key]

    return check


def _bind(query: Callable[[RetailTables], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(open_tables(spark, folder))

    return run


def _state(spark: SparkSession, folder: str) -> tuple:
    """The files of the tables, and whether tables written so far are still there."""
    names = ("orders", "lineitem", "customer", "part", "nation", "region")
    stamps = tuple(file_stamps(spark, f"{folder}/{name}.parquet") for name in names)
    return spark.sparkContext.applicationId, drops(), stamps


_CUBES: dict[tuple, cube.OrderCube] = {}


def _cube_of(spark: SparkSession, folder: str) -> cube.OrderCube:
    """The cube of the tables, built once for the same files and written tables."""
    key = _state(spark, folder)
    if key not in _CUBES:
        _CUBES.clear()
        _CUBES[key] = cube.build(open_tables(spark, folder))
    return _CUBES[key]


def _bind_cube(query: Callable[[RetailTables], DataFrame]) -> Query:
    """As the report job does: from the orders themselves if their ids repeat."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = open_tables(spark, folder)
        return query(t.with_cube(_cube_of(spark, folder)) if t.unique_order_ids else t)

    return run


_FITS: dict[tuple, _Fit] = {}


def _bind_fit(query: Callable[[_Fit], DataFrame], anew: bool) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        key = _state(spark, folder)
        if anew or key not in _FITS:
            _FITS.clear()
            _FITS[key] = _Fit(open_tables(spark, folder))
        return query(_FITS[key])

    return run


def queries() -> dict[str, Query]:
    found = {name: _bind(query) for name, query in _QUERIES.items()}
    found["cube_customer_rollup"] = lambda spark, folder: _cube_of(spark, folder).customer_rollup()
    found |= {name: _bind_cube(query) for name, query in _CUBE_QUERIES.items()}
    found |= {name: _bind_fit(query, anew=True) for name, query in _FIT_QUERIES.items()}
    return found | {name: _bind_fit(query, anew=False) for name, query in _FIT_CHECKS.items()}
