"""Helpers shared by the training-data operators.

Everything here is lazy or writes to the folder the cluster names in ``spark.checkpoint.dir``; nothing is kept on one
machine's disk.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only where none is set and Spark runs on one machine (tests) a temporary one is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
        if not root:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            root = tempfile.mkdtemp(prefix="riskweave-")
            context.setCheckpointDir(root)
    return root.rstrip("/")


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared root; the caller owns what it writes there."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus), F.lit(-1))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (case is ignored, as Spark does)."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def running(sizes: Column, chunk: int = 256) -> Column:
    """Sums of the entries before each entry of an array of ints. In two levels, so that no array is copied for each entry."""
    none = F.array().cast("array<int>")

    def before(a: Column) -> Column:
        return F.aggregate(
            a,
            F.struct(F.lit(0).alias("sum"), none.alias("out")),
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")),
            lambda acc: acc["out"],
        )

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)

    def placed(parts: Column) -> Column:
        starts = before(F.transform(parts, total))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), starts.alias("s")), lambda z: F.transform(before(z["p"]), lambda v: v + z["s"])))

    cuts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / chunk).cast("int"))
    return F.when(F.size(sizes) == 0, none).otherwise(let(F.transform(cuts, lambda k: F.slice(sizes, k * chunk + 1, F.lit(chunk))), placed))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``: Catalyst would otherwise copy the expression into
    every use, which makes a lookup inside a higher-order function quadratic."""
    return F.transform(F.array(value), body)[0]
