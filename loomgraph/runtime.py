"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one parquet table; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a master that runs on this machine only and is removed at the end of the
    process; a cluster without a shared folder is refused, since its executors could not read each other's files.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation of earlier rounds.

    A checkpoint keeps the planner's estimate of its size, and the estimate of a join is the product of its sides: in a
    loop of self joins the number of its digits doubles every round.  An estimate beyond any real size is dropped.
    """
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    plan = done._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRDD" or plan.stats().sizeInBytes() < 1 << 60:
        return done
    plain = df.sparkSession._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(plain, df.sparkSession)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
