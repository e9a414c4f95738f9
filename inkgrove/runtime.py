"""Session helpers: a shared folder that survives lost executors, and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Folders of tables written on the way, each with the folders it was computed from.
_SCRATCH: dict[str, set[str]] = {}
#: Operators of a logical plan that move no rows between partitions.
_NARROW = frozenset("Project Filter Union Generate Range LocalRelation SubqueryAlias MapInPandas MapInArrow ArrowEvalPython BatchEvalPython LogicalRDD Coalesce Repartition".split())


def _drop_own() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_drop_own)


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only in local mode, where driver and executors are one
    process, may it be missing: then a folder of our own serves. On a cluster without one this raises, as executors that
    write to their own disks would give incomplete results."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if root:
        if not existing.isDefined():
            spark.sparkContext.setCheckpointDir(root)
        return root
    if existing.isDefined():
        return existing.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="inkgrove-")
    _OWN.append(own)
    spark.sparkContext.setCheckpointDir("file://" + own)
    return "file://" + own


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables below the shared folder. What nobody released goes when the session's process ends."""
    outer = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, outer)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    outer = fs.makeQualified(p).toString()
    _SCRATCH[outer] = set()
    return f"{outer}/t"


def _drop(spark: SparkSession, folders: set[str]) -> int:
    for f in folders:
        if _SCRATCH.pop(f, None) is not None:
            fs, p = _file_system(spark, f)
            fs.delete(p, True)
    return len(folders)


def drop_scratch(spark: SparkSession) -> int:
    """Removes all tables this process wrote to the shared folder; results that still read them are lost."""
    return _drop(spark, set(_SCRATCH))


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end: for callers that consume the result inside."""
    before = set(_SCRATCH)
    try:
        yield
    finally:
        _drop(spark, set(_SCRATCH) - before)


def _roots(df: DataFrame) -> set[str]:
    """The scratch folders ``df`` reads, found at the leaves of its plan."""
    found: set[str] = set()
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.nodeName().startswith("Relation") or leaf.getClass().getSimpleName() == "LogicalRelation":
            relation = leaf.relation()
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                paths = relation.location().rootPaths()
                found |= {paths.apply(j).toString() for j in range(paths.size())}

    return {f for f in _SCRATCH if any(p.startswith(f + "/") for p in found)}


def release(df: DataFrame, deep: bool = False) -> int:
    """Removes the scratch tables ``df`` reads, once its rows have been consumed; ``df`` can't be read again.

    With ``deep`` also the tables these were computed from, and so on: for the final result of an operator.
    """
    todo, all_of = list(_roots(df)), set()
    while todo:
        f = todo.pop()
        if f not in all_of:
            all_of.add(f)
            todo += _SCRATCH.get(f, ()) if deep else ()
    return _drop(df.sparkSession, all_of)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: a columnar lineage cut."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    _SCRATCH[path.rsplit("/", 1)[0]] = _roots(df)
    return spark.read.schema(df.schema).parquet(path)


def _narrow(plan) -> bool:
    kind = plan.getClass().getSimpleName()
    if kind not in _NARROW and kind != "LogicalRelation" or kind == "Repartition" and plan.shuffle():
        return False
    children = plan.children()
    return all(_narrow(children.apply(k)) for k in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its source has far fewer partitions than there are cores (one small file, say).

    Work per row is heavy in the operators that use this, so a shuffle of a small input pays; inputs of any size that
    already have enough partitions are left alone, as are inputs that are shuffled anyway, whose partitions can't be counted
    without running them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if not _narrow(execution.optimizedPlan()):
        return df
    return df.repartition(cores) if 2 * execution.toRdd().getNumPartitions() <= cores else df
