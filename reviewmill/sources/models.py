"""Model persistence with the metrics of the run beside the weights.

Every save has a folder of its own under ``models``; ``best`` and ``latest`` are pointers to one,
written last. A save that breaks off leaves both where they were.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import versions


def save_model(
    spark: SparkSession,
    model: PipelineModel,
    root: str,
    epoch: int,
    metrics: dict[str, float],
    primary_metric: str,
    greater_is_better: bool = True,
) -> bool:
    """Save as ``latest``, and as ``best`` when the primary metric strictly improves.

    The pointer to the best knows its metrics, so a resumed run goes on where it stopped.
    """
    name = next((m for m in (primary_metric, f"val_{primary_metric}") if m in metrics), None)
    if name is None:
        raise KeyError(f"primary metric {primary_metric!r} not found in {sorted(metrics)}")
    improved = metrics[name] == metrics[name]  # NaN never improves
    best = versions.current(spark, f"{root}/best")
    if improved and best is not None:
        old = best[1]["metrics"][name]
        improved = metrics[name] > old if greater_is_better else metrics[name] < old
    last = versions.current(spark, f"{root}/latest")
    version = last[0] + 1 if last else 1
    folder = f"models/{version:09d}"
    model.write().overwrite().save(f"{root}/{folder}")
    columns = [F.lit(epoch).cast("int").alias("epoch")]
    columns += [F.lit(float(v)).alias(k) for k, v in sorted(metrics.items())]
    spark.range(1).select(*columns).write.mode("append").parquet(f"{root}/metrics")
    saved = {"model": folder, "metrics": {"epoch": epoch, **{k: float(v) for k, v in sorted(metrics.items())}}}
    # The better model first: between the two pointers the old ``latest`` is still a whole one.
    if improved:
        versions.publish(spark, f"{root}/best", best[0] + 1 if best else 1, saved)
    versions.publish(spark, f"{root}/latest", version, saved)
    return improved


def load_model(
    spark: SparkSession, root: str, primary_metric: str, which: str = "best",
) -> tuple[PipelineModel, dict]:
    """The saved model and the metrics row it was saved with."""
    if which not in ("best", "latest"):
        raise ValueError(f"unknown checkpoint {which!r}")
    found = versions.current(spark, f"{root}/{which}")
    if found is None:
        raise FileNotFoundError(f"{root}/{which}")
    saved = found[1]
    if not {primary_metric, f"val_{primary_metric}"} & set(saved["metrics"]):
        raise KeyError(f"primary metric {primary_metric!r} not found in {sorted(saved['metrics'])}")
    return PipelineModel.load(f"{root}/{saved['model']}"), saved["metrics"]
