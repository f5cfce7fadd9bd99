"""Checkpointed stages (A15): reuse a stored result, else compute and store it.

Stage tables live under the shared folder the cluster names in
``spark.checkpoint.dir`` (or a caller-given root), never on a machine-local
path; a ``_SUCCESS`` marker means the stage completed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmap.session import checkpoint_root, exists, touch


def stage(spark: SparkSession, name: str, compute: Callable[[], DataFrame], reuse: bool = True,
          root: str | None = None) -> DataFrame:
    """Read ``<root>/<name>`` when complete and ``reuse``; otherwise write ``compute()`` there."""
    base = (root or checkpoint_root(spark)).rstrip("/")
    path = f"{base}/{name}"
    if reuse and exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def model_stage(spark: SparkSession, name: str, fit: Callable[[], object], loader, reuse: bool = True,
                root: str | None = None):
    """Same for a model: ``loader.load(path)`` when stored, else fit and save.

    A model with its own ``save`` (a topic model) is stored by that, an ML model by its
    writer; a marker file written last tells that the model is complete.
    """
    base = (root or checkpoint_root(spark)).rstrip("/")
    path = f"{base}/{name}"
    if reuse and exists(spark, f"{path}/_STORED"):
        return loader.load(path)
    model = fit()
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    else:
        model.save(path)
    touch(spark, f"{path}/_STORED")
    return model
