"""The batch jobs: publish the exports, write all reports, run the churn model."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from martlens.churn import evaluate, features, model, nodes
from martlens.fixed_values import CATEGORIES
from martlens.operators import cube
from martlens.operators import customers as C
from martlens.operators import products as P
from martlens.operators import quality as Q
from martlens.operators import revenue as R
from martlens.operators.dashboard import dashboard
from martlens.session import drop_written
from martlens.sources import readers, sinks
from martlens.sources.tables import RetailTables

# Where the churn job keeps what later scoring needs.
MODEL, CODES = "churn_model", "churn_category_codes"


def reports(t: RetailTables, as_of: date | str) -> dict[str, Callable[[], DataFrame]]:
    """The named reports with their default parameters."""
    return {
        "kpi_summary": lambda: R.kpi_summary(t),
        "monthly_revenue_trend": lambda: R.monthly_revenue_trend(t),
        "yearly_revenue": lambda: R.yearly_revenue(t),
        "revenue_mom_growth": lambda: R.revenue_mom_growth(t),
        "clv_top20": lambda: C.clv(t),
        "rfm_segments": lambda: C.rfm_segments(t, as_of),
        "rfm_histogram": lambda: C.rfm_histogram(t, as_of),
        "rfm_medians": lambda: C.rfm_medians(t, as_of),
        "churn_by_region_tier": lambda: C.churn_by_region_tier(t, as_of),
        "churn_by_region": lambda: C.churn_by_region(t, as_of),
        "top_products": lambda: P.product_revenue(t),
        "category_mix": lambda: P.category_mix(t),
        "low_stock_alert": lambda: P.low_stock(t),
        "revenue_by_region": lambda: R.revenue_by_region(t),
        "payment_preference": lambda: R.payment_preference(t),
        "order_status_breakdown": lambda: R.order_status_breakdown(t),
        "shipping_by_region": lambda: R.shipping_by_region(t),
        "duplicate_keys": lambda: t.checks.get(readers.CONSTRAINTS, Q.duplicate_keys(t)),
        "orphan_keys": lambda: t.checks.get(readers.ORPHANS, Q.orphan_keys(t)),
    }


def publish_exports(
    spark: SparkSession, exports: str, folder: str, rejects: str | None = None,
    max_share: float = 0.001,
) -> RetailTables:
    """Load the four CSV exports and replace the published tables with them.

    A malformed row stops the load, or, with a folder for ``rejects``, goes there,
    unless more than ``max_share`` of a table's rows do.
    """
    if rejects:
        loaded = sinks.quarantine(spark, exports, rejects, max_share)
    else:
        loaded = readers.read_csv_tables(spark, exports)
    sinks.publish(loaded, folder)
    return readers.read_published(spark, folder)


def write_reports(
    spark: SparkSession,
    folder: str,
    output: str,
    as_of: date | str,
    predictions: str | None = None,
    cube_folder: str | None = None,
    **slicers,
) -> None:
    """Write every report, and every dashboard visual below its page.

    Orders are summed once, and reports are put together from the partial sums. With
    ``cube_folder`` these are kept there, and only months that changed since the last
    call are summed again. If order ids repeat, reports read the orders themselves.
    ``slicers`` are those of :func:`martlens.operators.dashboard.dashboard`.
    """
    t = readers.read_published(spark, folder, predictions)
    try:
        if t.unique_order_ids and cube_folder:
            cube.refresh(spark, folder, cube_folder)
            t = t.with_cube(cube.read(spark, cube_folder))
        elif t.unique_order_ids:
            t = t.with_cube(cube.build(t))
        for name, report in reports(t, as_of).items():
            report().write.mode("overwrite").parquet(f"{output}/reports/{name}")
        for page, visuals in dashboard(t, as_of, **slicers).items():
            for name, visual in visuals.items():
                visual().write.mode("overwrite").parquet(f"{output}/dashboard/{page}/{name}")
    finally:
        drop_written(spark)


def run_churn_model(
    spark: SparkSession, folder: str, output: str, as_of: date | str, **forest
) -> None:
    """Train, evaluate and export churn predictions for all customers."""
    t = readers.read_published(spark, folder)
    try:
        _churn_results(spark, t, output, as_of, **forest)
    finally:
        drop_written(spark)


def _churn_results(
    spark: SparkSession, t: RetailTables, output: str, as_of: date | str, **forest
) -> None:
    people = features.joined_customers(t, as_of)
    codes = features.category_codes(people, CATEGORIES)
    codes.write.mode("overwrite").parquet(f"{output}/{CODES}")
    matrix = features.feature_matrix(t, as_of, codes=codes)
    forest_model, tested = model.train_and_score(matrix, **forest)
    forest_model.write().overwrite().save(f"{output}/{MODEL}")
    predictions = evaluate.risk_bands(model.score(forest_model, matrix))
    sinks.export_predictions(predictions, f"{output}/churn_predictions")
    exported = readers.read_predictions(spark, f"{output}/churn_predictions")
    out_of_fold = model.cv_scores(matrix, **forest)
    results = {
        "dataset_summary": features.churn_dataset_summary(matrix),
        "classification_report": evaluate.classification_report(tested),
        "roc_auc": evaluate.roc_auc(tested),
        "roc_curve": evaluate.roc_curve(tested),
        "confusion_matrix": evaluate.confusion_matrix(tested),
        "cross_validation_scores": out_of_fold,
        "cross_validation": model.auc_of_folds(out_of_fold),
        "feature_importance": model.importances(forest_model, matrix),
        "forest_nodes": nodes.forest_nodes(spark, forest_model),
        "risk_band_counts": evaluate.risk_band_counts(exported),
    }
    for name, result in results.items():
        result.write.mode("overwrite").parquet(f"{output}/churn/{name}")


def score_customers(
    spark: SparkSession, folder: str, fitted: str, output: str, as_of: date | str
) -> None:
    """Export predictions by the model that :func:`run_churn_model` wrote to ``fitted``.

    Categories keep the codes the model was fitted with; new ones share one more.
    """
    t = readers.read_published(spark, folder)
    codes = spark.read.parquet(f"{fitted}/{CODES}")
    forest = PipelineModel.load(f"{fitted}/{MODEL}")
    try:
        matrix = features.feature_matrix(t, as_of, codes=codes)
        bands = evaluate.risk_bands(model.score(forest, matrix))
        sinks.export_predictions(bands, f"{output}/churn_predictions")
    finally:
        drop_written(spark)
