"""Readers and writers of traces and recordings: JSON, JSON Lines, nested bundles, CSV, and results."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

#: A recording: neurons by time, labels by neuron index, behaviour by name, and the clock.
BUNDLE = (
    "metadata struct<uid:string,paper_id:string,dataset_type:array<string>,n_neuron:int>, gcamp struct<trace_array:array<array<double>>>, "
    "label map<string,struct<neuron_class:string,label:string>>, behavior map<string,array<double>>, timing struct<timestamp_confocal:array<double>,mean_timestep:double,max_t:int>"
)


def read_records(spark: SparkSession, path: str, trace_id: str = "0") -> DataFrame:
    """A trace from a ``.json`` list of records, one per tick, as (trace_id, t, var, value). The list's order is time; it has to be in one document, which Spark reads as one."""
    if not path.endswith(".json"):
        raise ValueError(f"not a .json trace: {path}")
    text = spark.read.text(path, wholetext=True)
    ticks = text.select(F.posexplode(F.from_json("value", "array<map<string,double>>")).alias("t", "row"))
    return ticks.select(F.lit(trace_id).alias("trace_id"), F.col("t").cast("long").alias("t"), F.explode("row").alias("var", "value"))


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON Lines with an explicit schema; blank lines are skipped and a path that does not exist is empty."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.globStatus(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def to_long(wide: DataFrame, trace_id: str | None = None, t: str = "t") -> DataFrame:
    """Numeric columns of a wide table as (trace_id, t, var, value)."""
    names = [f.name for f in wide.schema.fields if isinstance(f.dataType, NumericType) and f.name not in (t, trace_id)]
    key = F.col(trace_id).cast("string") if trace_id else F.lit("0")
    cells = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`").cast("double") for n in names]))
    return wide.select(key.alias("trace_id"), F.col(t).cast("long").alias("t"), F.explode(cells).alias("var", "value"))


def numeric_leaves(df: DataFrame, skip: tuple[str, ...] = ("image", "rgb")) -> list[str]:
    """Paths of all numeric fields of nested records, but for those with a skipped word in their names."""

    def walk(schema: StructType, prefix: str) -> list[str]:
        out: list[str] = []
        for f in schema.fields:
            path = prefix + f.name
            if any(w in path.lower() for w in skip):
                continue
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, path + ".")
            elif isinstance(f.dataType, NumericType):
                out.append(path)
        return out

    return walk(df.schema, "")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Recordings from JSON files, compressed or not, one document each."""
    return spark.read.schema(BUNDLE).option("multiLine", True).json(path)


def bundle_traces(bundles: DataFrame) -> DataFrame:
    """Neuron traces (trace_id, t, var, value): neurons by time turned to rows."""
    neurons = bundles.select(F.col("metadata.uid").alias("trace_id"), F.posexplode("gcamp.trace_array").alias("neuron", "values"))
    return neurons.select("trace_id", F.concat(F.lit("n"), "neuron").alias("var"), F.posexplode("values").alias("t", "value")).select("trace_id", F.col("t").cast("long").alias("t"), "var", "value")


def bundle_classes(bundles: DataFrame) -> DataFrame:
    """Class of each labelled neuron; keys that are no index of a neuron are left out."""
    rows = bundles.select(F.col("metadata.uid").alias("trace_id"), F.size("gcamp.trace_array").alias("n"), F.explode("label").alias("k", "label"))
    return rows.where("try_cast(k as int) between 0 and n - 1").select("trace_id", F.concat(F.lit("n"), F.col("k")).alias("var"), F.col("label.neuron_class").alias("neuron_class"))


def cohort(bundles: DataFrame, kinds: tuple[str, ...] = ("neuropal", "baseline"), least_labelled: int = 1) -> DataFrame:
    """Recordings of all the kinds named, with enough labels."""
    types = F.transform("metadata.dataset_type", lambda x: F.lower(x))
    wanted = [F.array_contains(types, k) for k in kinds]
    found = bundles.where(F.size("label") >= least_labelled)
    for w in wanted:
        found = found.where(w)
    return found


def write_result(result: DataFrame, path: str, force: bool = False) -> str:
    """Write JSON to ``path``, or, if it exists and ``force`` is not set, beside it under a name with the time."""
    spark = result.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    taken = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if taken and not force:
        path = f"{path}-{datetime.now(timezone.utc):%Y%m%dT%H%M%S}"
    result.write.mode("overwrite" if force else "errorifexists").json(path)
    return path
