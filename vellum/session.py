"""The Spark session the engine expects, and where its tables are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """What a deployment may set. Weights of 0 switch a ranking multiplier off."""

    dim: int = 64
    window: int = 512
    overlap: int = 64
    quality_weight: float = 1.0
    recency_weight: float = 1.0
    rerank: bool = False
    horizon: str = "2026-04-01"
    ignore_dirs: tuple[str, ...] = ("Templates",)

    #: Vector widths of well-known embedding models.
    DIMS = {"BAAI/bge-small-en-v1.5": 384, "BAAI/bge-base-en-v1.5": 768, "BAAI/bge-large-en-v1.5": 1024}

    @staticmethod
    def dim_of(model: str) -> int:
        if model not in Settings.DIMS:
            raise ValueError(f"unknown embedding model {model!r}; state its dim")
        return Settings.DIMS[model]


def session(app: str = "vellum", master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    }
    return builder.config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that every node reaches, below spark.checkpoint.dir. Where that is unset and all runs in one process, below a
    folder of our own; on a cluster that is an error."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/vellum-{uuid.uuid4().hex}"
