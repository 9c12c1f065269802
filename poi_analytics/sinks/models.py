"""Saved models that readers never see half of.

A model is saved into a version folder of its own, ``<root>/versions/<n>``; only when that is complete is
its manifest ``<root>/manifest/<n>.json`` put in place, by renaming a finished file.  Readers go by
manifests alone, so a save that is killed leaves the newest complete version in use and its
leftovers unseen.  Works on any Hadoop file system.
"""

from __future__ import annotations

import json
import re

from pyspark.ml import PipelineModel
from pyspark.ml.classification import FMClassificationModel, MultilayerPerceptronClassificationModel
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a manifest's ``kind`` is loaded with.
KINDS = {c.__name__: c for c in (ALSModel, PipelineModel, FMClassificationModel, MultilayerPerceptronClassificationModel)}


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions, oldest first."""
    fs, folder = _fs(spark, f"{root}/manifest")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", n) for n in names) if m)


def version_path(root: str, version: int) -> str:
    return f"{root}/versions/{version}"


def _next_version(spark: SparkSession, root: str) -> int:
    """One above every version begun, complete or not."""
    fs, folder = _fs(spark, f"{root}/versions")
    begun = [int(f.getPath().getName()) for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return max([0, *begun, *versions(spark, root)]) + 1


def _publish(spark: SparkSession, root: str, version: int, kind: str) -> None:
    fs, final = _fs(spark, f"{root}/manifest/{version}.json")
    _, draft = _fs(spark, f"{root}/manifest/.{version}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"version": version, "kind": kind}).encode()))
    out.close()
    if not fs.rename(draft, final):
        raise OSError(f"version {version} of {root} exists already")


def save_version(model, root: str, spark: SparkSession) -> int:
    """Save a fitted model as a new version and publish it; the number of the version."""
    kind = type(model).__name__
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    version = _next_version(spark, root)
    model.write().save(version_path(root, version))
    _publish(spark, root, version, kind)
    return version


def load_version(spark: SparkSession, root: str, version: int | None = None):
    """The model of a published version, the newest by default."""
    known = versions(spark, root)
    if version is None and known:
        version = known[-1]
    if version not in known:
        raise FileNotFoundError(f"no published version {'' if version is None else version} in {root}")
    kind = spark.read.json(f"{root}/manifest/{version}.json").first()["kind"]
    return KINDS[kind].load(version_path(root, version))


def factor_scan(model: ALSModel, side: str) -> DataFrame:
    """(id, vector array<double>) of the ``user`` or ``item`` factors of a loaded model."""
    factors = {"user": model.userFactors, "item": model.itemFactors}[side]
    return factors.select("id", F.transform("features", lambda x: x.cast("double")).alias("vector"))
