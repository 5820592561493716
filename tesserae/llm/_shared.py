"""What the operators of this subpackage share: scratch tables and connected components."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number of rounds after which the component search gives up; each round at least halves the depth of the forest.
MAX_ROUNDS = 60


def ship(module: str) -> None:
    """Send a module's functions to Python workers by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


#: Rows of a batch that a function sees, at most. Spark bounds the bytes of the batches that it sends.
BATCH_ROWS = 500


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` whose batches are handed on in slices of few rows, so that a worker's memory stays bounded."""
    most = BATCH_ROWS

    def sliced(batches):
        return function(b.slice(at, most) for b in batches for at in range(0, b.num_rows, most))

    return df.mapInArrow(sliced, schema)


#: The folder of this process in local mode where none is named.
_LOCAL: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one is made only in local mode, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _LOCAL
    _LOCAL = _LOCAL or "file://" + tempfile.mkdtemp(prefix="tesserae-")
    return _LOCAL


class Scratch:
    """Tables written to the shared scratch folder, so that no later job depends on a lost executor's shuffle files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write_parts(self, df: DataFrame, name: str, part: str) -> DataFrame:
        """As :meth:`write`, in a folder for each value of the column ``part``, which reads of one value skip to."""
        df.write.partitionBy(part).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no unfinished result still reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that is not among ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (u long, v long); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each is one min aggregate with map-side combine and
    one equi-join, so a hub with a third of all edges is split by adaptive skew handling and no
    neighbourhood is ever gathered in one task. Self-loops are ignored; nodes without another
    neighbour do not appear. Null ends are dropped.
    """
    spark = edges.sparkSession
    cur = scratch.write(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}-0"
    )
    state = _fingerprint(cur)
    for i in range(1, MAX_ROUNDS):
        if state[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, f"{tag}-{i}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = scratch.write(small.select("e.*").where("u <> v").distinct(), f"{tag}-{i}")
        scratch.drop(f"{tag}-{i}-large", f"{tag}-{i - 1}")
        before, state = state, _fingerprint(small)
        cur = small
        if state == before:
            break
    else:
        raise RuntimeError("the component search did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())
