"""The whole analysis of one table: raw reports, cleaning, statistical profile, chart data and context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.operators import charts, cluster, context, importance, quality, schema, stats
from tablescope.operators.clean import clean_table
from tablescope.operators.names import name_map, normalize_names
from tablescope.plans.columns import collected
from tablescope.plans.together import together
from tablescope.sources.csv import load_csv


@dataclass
class Profile:
    """Schema and quality describe the raw table; the profile, charts and context describe the clean one."""

    raw: DataFrame
    clean: DataFrame
    names: DataFrame
    size_mb: float
    schema: dict[str, DataFrame]
    quality: dict[str, DataFrame]
    profiling: dict[str, DataFrame]
    clustering: cluster.Clustering | None
    charts: dict[str, DataFrame] = field(default_factory=dict)
    staged: str | None = None

    def release(self) -> None:
        """Drop the kept copy of the table and the files of a staged one."""
        self.raw.unpersist()
        if self.staged:
            jvm = self.raw.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.staged)
            path.getFileSystem(self.raw.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

    def info(self) -> DataFrame:
        return context.dataset_info(
            self.clean,
            self.size_mb,
            self.quality["quality_score"],
            self.schema["target_candidates"],
            self.schema["time_columns"],
        )

    def context(self, with_profile: bool = False) -> DataFrame:
        return context.report_context(
            self.clean, self.size_mb, self.schema, self.quality, self.profiling if with_profile else None
        )


def profiling_report(clean: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """All statistical reports of a clean table but clustering; moments, pairs and importance are computed once."""
    shapes, pairs, ranked = together(
        clean.sparkSession,
        [
            lambda: collected(stats.column_shapes(clean)),
            lambda: stats.local_pairs(clean),
            lambda: collected(importance.feature_importance(clean, target)),
        ],
    )
    return {
        "descriptive_stats": stats.descriptive_stats(clean, shapes),
        "skewed_columns": stats.skewed_columns(clean, shapes),
        "high_kurtosis": stats.high_kurtosis(clean, shapes),
        "normality_test": stats.normality_test(clean, shapes),
        "correlation_r": pairs,
        "correlation_pairs": stats.correlation_report(clean, pairs),
        "correlation_top": stats.correlation_top(clean, pairs=pairs),
        "correlation_summary": stats.correlation_summary(clean, pairs),
        "feature_importance": ranked,
    }


def dashboard_charts(profile: Profile) -> dict[str, DataFrame]:
    """The data of every chart that applies to the table. Each entry is lazy apart from the few numbers that choose
    its columns and bins."""
    raw, clean, facts = profile.raw, profile.clean, profile.schema["facts"]
    kinds = {r["column"]: r["semantic_type"] for r in schema.semantic_types(raw, facts).collect()}
    nums = [c for c in raw.columns if kinds[c] == "numeric"]
    cats = [c for c in raw.columns if kinds[c] == "categorical"]
    score = profile.quality["quality_score"]
    quality_report, profiling = profile.quality, profile.profiling
    build: dict[str, Callable[[], DataFrame | None]] = {
        "quality_gauge": lambda: charts.chart_gauge(score),
        "quality_dimensions": lambda: charts.chart_dimensions(score),
        "missing_values": lambda: charts.chart_missing(quality_report["missing_values"]),
        "outliers": lambda: charts.chart_box(clean, quality_report["iqr_outliers"]),
        "class_balance": lambda: charts.chart_class_balance(raw, quality_report["class_imbalance"]),
        "feature_importance": lambda: charts.chart_importance(profiling["feature_importance"]),
        "correlation_pairs": lambda: charts.chart_corr_pairs(profiling["correlation_top"]),
    }
    if nums:
        build["distributions"] = lambda: charts.hist_grid(clean, nums)
        build["dist"] = lambda: charts.hist_top_variance(clean, nums)
    if cats:
        build["comp"] = lambda: charts.composition(clean, cats[0])
    if len(nums) >= 2:
        among = F.col("col1").isin(nums) & F.col("col2").isin(nums)
        build["rel"] = lambda: charts.scatter_points(clean, nums[0], nums[1], cats[0] if cats else None)
        build["heat"] = lambda: charts.correlation_heatmap(clean.select(*nums), profiling["correlation_r"].filter(among))
    if cats and nums:
        build["bar"] = lambda: charts.category_mean(clean, cats[0], nums[0])
    best = profile.schema["time_columns"].filter("is_best").first()
    if best and nums:
        frequency = profile.schema["time_frequency"].first()
        width = charts.BUCKET_WIDTHS.get(frequency["frequency"] if frequency else None, "1 day")
        build["time_series"] = lambda: charts.time_series(clean, best["column"], nums, width)
    if profile.clustering:
        build["clustering"] = lambda: charts.chart_clusters(profile.clustering)
        build["silhouette"] = lambda: charts.chart_silhouette(profile.clustering)
    found = dict(zip(build, together(clean.sparkSession, list(build.values()))))
    return {name: df for name, df in found.items() if df is not None}


def profile_table(
    df: DataFrame,
    size_mb: float = 0.0,
    run_clustering: bool = True,
    with_charts: bool = True,
    keep: bool = False,
    partitions: int | None = None,
) -> Profile:
    """Analyse a table: names normalised, raw reports, cleaning, statistics of the clean table, chart data.

    Each pass reads the table anew, and only the columns it needs. The caller who knows that the table fits asks to
    ``keep`` it (memory, then disk) while it is analysed, and to spread one that lies in few splits over
    ``partitions``. Neither changes an answer.
    """
    names = name_map(df)
    raw = normalize_names(df)
    if partitions:
        raw = raw.repartition(partitions)
    if keep:
        raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
    schema_report, clean = together(df.sparkSession, [lambda: schema.schema_report(raw), lambda: clean_table(raw)])
    targets = [r["column"] for r in schema_report["target_candidates"].collect()]
    quality_report, profiling, found = together(
        df.sparkSession,
        [
            lambda: quality.quality_report(raw, targets, schema_report["facts"]),
            lambda: profiling_report(clean, targets[0] if targets else None),
            lambda: cluster.kmeans_search(clean) if run_clustering else None,
        ],
    )
    if found:
        profiling["kmeans_k_scores"] = found.k_scores()
        profiling["kmeans_sizes"] = found.sizes()
        profiling["kmeans_centers"] = found.centers()
    result = Profile(raw, clean, names, size_mb, schema_report, quality_report, profiling, found)
    if with_charts:
        result.charts = dashboard_charts(result)
    return result


def load_analyse_clean(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    multi_line: bool = False,
    stage_to: str | None = None,
    **options,
) -> Profile:
    """The same for CSV files.

    Many passes follow, and each would parse the whole text again. With ``stage_to``, a path in a folder that all
    executors reach, the table is written there once as Parquet, from which a pass reads only its columns;
    ``Profile.release`` deletes it.
    """
    loaded = load_csv(spark, path, encoding, multi_line=multi_line)
    table = loaded.df
    if stage_to:
        table = normalize_names(table)
        table.write.parquet(stage_to)
        table = spark.read.parquet(stage_to)
    result = profile_table(table, loaded.size_mb, **options)
    result.names = name_map(loaded.df)
    result.staged = stage_to
    return result
