"""The whole way from a raw table to synthetic tables and reports, by a configuration instead of prompts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsynth import gate, impute
from tabsynth.cv import augmented_classification_cv, augmented_regression_cv
from tabsynth.expr import add_formulas, auto_bounds
from tabsynth.io import read_table, write_datasets, write_report
from tabsynth.report import round_report
from tabsynth.sample import oversample
from tabsynth.schema import align_schema, drop_by_index, drop_indicators, infer_schema, sanitize_columns
from tabsynth.synth import cart_generator, copula_generator


@dataclass
class Config:
    path: str
    output: str
    fmt: str = "csv"
    drop_first: bool = True
    drop_columns: list[int] = field(default_factory=list)
    overrides: dict[str, str] = field(default_factory=dict)
    formulas: dict[str, str] = field(default_factory=dict)
    constraints: list[str] = field(default_factory=list)
    class_target: str | None = None
    regression_target: str | None = None
    imputations: tuple[str, ...] = ("iter", "knn", "mi")
    generators: tuple[str, ...] = ("CART", "GaussianCopula")
    thresholds: dict[str, float] = field(default_factory=lambda: dict(gate.THRESHOLDS))
    settings: gate.Settings = field(default_factory=gate.Settings)
    splits: int = 5
    repeats: int = 3
    trees: int = 300
    rows: int | None = None
    wanted: list[str] | None = None
    seed: int = 42


def run_pipeline(spark: SparkSession, c: Config) -> dict[str, DataFrame]:
    """Report frames: metrics, and with targets classification and regression summaries and fold scores. Also writes them, and the datasets."""
    raw = drop_by_index(sanitize_columns(read_table(spark, c.path, c.fmt, c.drop_first)), c.drop_columns).withColumn("_key", F.monotonically_increasing_id())
    raw.write.mode("overwrite").parquet(f"{c.output}/raw")
    raw = spark.read.parquet(f"{c.output}/raw")
    meta = align_schema(raw.drop("_key"), infer_schema(raw.drop("_key")), c.overrides)
    n = c.rows or gate.target_rows(raw.count())
    repaired = impute.impute_categorical_rf(raw, meta=meta, trees=100, seed=c.seed)[0].checkpoint()
    filled = {
        "iter": lambda: impute.impute_iterative(repaired, meta=meta)[0],
        "knn": lambda: impute.impute_knn(repaired, meta=meta, key="_key")[0],
        "mi": lambda: impute.add_missing_indicators(repaired),
    }
    bounds = auto_bounds(repaired.drop("_key")) + c.constraints
    reports, quality = {}, None
    for name in c.imputations:
        table = filled[name]().checkpoint()
        body = table.drop("_key")
        full = align_schema(body, meta)
        real = oversample(table, c.class_target, ["_key"], c.seed).drop("draw", "_key") if c.class_target else body
        makers = {"CART": cart_generator(full), "GaussianCopula": copula_generator(full)}
        limits = {"CART": c.thresholds, "GaussianCopula": {k: min(v, gate.COPULA_THRESHOLDS.get(k, v)) if gate.DIRECTIONS.get(k) == "max" else v for k, v in c.thresholds.items()}}
        made = gate.run_generators({g: makers[g] for g in c.generators}, real, body, n, full, bounds, f"{c.output}/batches/{name}", limits, ros_target=c.class_target, settings=c.settings)
        shown = add_formulas(drop_indicators(body, full)[0], c.formulas)
        outputs = {g: add_formulas(drop_indicators(df, full)[0], c.formulas) for g, df in made.items()}
        write_datasets(shown, f"{c.output}/datasets", name, "real")
        for g, df in outputs.items():
            write_datasets(df, f"{c.output}/datasets", name, g)
        if outputs:
            keyed = {g: df.withColumn("_s", F.monotonically_increasing_id()) for g, df in outputs.items()}
            rows = gate.compare_all(name, shown.withColumn("_r", F.monotonically_increasing_id()), keyed, infer_schema(shown), bounds, ("_r", "_s"), c.wanted)
            quality = rows if quality is None else quality.unionByName(rows)
        for g in c.generators:
            common = dict(meta=meta | {"_key": "primary_key"}, key="_key", method=name, generator=makers[g], generator_name=g, constraints=c.constraints, formulas=c.formulas, splits=c.splits, repeats=c.repeats, target_rows=n, trees=c.trees, settings=c.settings, seed=c.seed)
            for kind, target, run in (("classification", c.class_target, augmented_classification_cv), ("regression", c.regression_target, augmented_regression_cv)):
                if target:
                    for part, df in zip(("summary", "fold_scores"), run(raw, target, path=f"{c.output}/folds/{kind}/{name}/{g}", **common), strict=True):
                        key = f"{kind}_{part}"
                        stamped = round_report(df, 4, target)
                        reports[key] = stamped if key not in reports else reports[key].unionByName(stamped)
    if quality is not None:
        reports["metrics"] = round_report(quality, 3)
    write_report(reports, f"{c.output}/reports")
    return reports
