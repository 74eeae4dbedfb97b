"""Standing registry tables that batches add to, partitioned by key range and batch.

Registration only adds rows: known definitions, ids and first attributes stay. So a batch writes its new rows as
partitions (part, batch) of its own, by dynamic partition overwrite, and reads only the key ranges that its
definitions lie in; nothing that stands is written again. A batch that runs again, after a lost job or in a
replayed stream, reads what stood before it and overwrites its own partitions with the same rows.

Tables below a path: variants and identifiers by part, the key range of the definition (reference and SPAN letters);
holders(ca_id, variant_key) by part, the range of the id (IDS of them); tops(top) with the greatest id after each batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from varloom.session import saved

from . import registry

SPAN, IDS = 10_000_000, 1_000_000
SCHEMAS = registry.TABLES | {"holders": "ca_id long, variant_key string", "tops": "top long"}


def definition_part() -> Column:
    return F.concat_ws("-", F.col("ref_id").cast("string"), F.floor(F.col("n_left") / SPAN).cast("string"))


def id_part(column: str) -> Column:
    return F.floor(F.col(column) / IDS).cast("string")


def read(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame:
    """A table's rows with part and batch, of the batches before one if that is given; empty where nothing stands."""
    schema = StructType.fromDDL(SCHEMAS[name]).add("part", "string").add("batch", "long")
    folder = f"{path.rstrip('/')}/{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(folder)
    return rows if before is None else rows.where(F.col("batch") < before)


def _parts(rows: DataFrame) -> list[str]:
    """The key ranges that rows lie in: as many as the genome has ranges at most."""
    return [r["part"] for r in rows.select("part").where("part is not null").distinct().collect()]


def _add(rows: DataFrame, path: str, name: str, batch: int) -> None:
    columns = [f.name for f in StructType.fromDDL(SCHEMAS[name])]
    (rows.select(*columns, "part").withColumn("batch", F.lit(batch)).repartition("part").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(f"{path.rstrip('/')}/{name}"))


def register(path: str, batch: DataFrame, ids: DataFrame, number: int) -> DataFrame:
    """Registers a batch (see registry.register) under its number, from 1; the answers, a row each.

    Batches are numbered in the order in which they are registered; only the last one may run again.
    """
    spark = batch.sparkSession
    batch = saved(batch.withColumn("part", definition_part()), "registry-batch")
    where = _parts(batch)
    variants = read(spark, path, "variants", number).where(F.col("part").isin(where))
    known = read(spark, path, "identifiers", number).where(F.col("part").isin(where))
    asked = _parts(batch.select(id_part("given_id").alias("part")))
    holders = read(spark, path, "holders", number).where(F.col("part").isin(asked))
    top = read(spark, path, "tops", number).agg(F.max("top")).first()[0] or 0
    new, extra, answer = registry.upsert(batch.drop("part"), ids, variants, known, holders.select("ca_id", "variant_key"), top)
    new = saved(new, "registry-new")
    extra = saved(extra, "registry-ids")
    answer = saved(answer, "registry-answers")
    places = batch.select("variant_key", "part").dropDuplicates(["variant_key"])
    _add(new.withColumn("part", definition_part()), path, "variants", number)
    _add(extra.join(places, "variant_key"), path, "identifiers", number)
    _add(new.withColumn("part", id_part("ca_id")), path, "holders", number)
    last = new.agg(F.greatest(F.coalesce(F.max("ca_id"), F.lit(0)), F.lit(top)).alias("top"))
    _add(last.withColumn("part", F.lit("all")), path, "tops", number)
    return answer
