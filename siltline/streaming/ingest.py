"""Incremental ingestion of landed records, and bookkeeping about what is known of a source."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.operators.materialise import materialise
from siltline.operators.skew import broadcast_if_small


def ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: T.StructType | str, form: str = "json", files_per_batch: int = 1_000) -> None:
    """Adds all files that are new in ``landing`` to the Parquet ``table``, then ends.

    The checkpoint remembers which files were read. A batch writes the folder batch_id=N and overwrites it if
    it is run again, so that a restart neither loses nor doubles rows.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(landing)

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={number}")

    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start().awaitTermination()


def latest(rows: DataFrame, keys: Sequence[str], time: str, order: Sequence[str] = ()) -> DataFrame:
    """The latest row of each key (null times first), of equal times the greatest by ``order``. Added up on the map side."""
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(F.col(time).isNotNull(), F.col(time), *order)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns))


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Old and new records, one per key, the latest winning."""
    return latest(old.unionByName(new), keys, time)


def until_run(rows: DataFrame, source: str, place: str, flagged: Column, length: int) -> DataFrame:
    """Each source's rows up to its first run of ``length`` consecutive flagged rows, the run included.

    ``place`` numbers the rows of a source without gaps. It serves to stop at known ids or at rows that are
    too old. A flagged row counts for the places of the runs it may end in; sums find full runs, so that no
    source is sorted in one task.
    """
    marks = rows.filter(flagged).select(source, F.explode(F.sequence(F.col(place), F.col(place) + (length - 1))).alias("_end"))
    stops = marks.groupBy(source, "_end").count().filter(F.col("count") >= length).groupBy(source).agg(F.min("_end").alias("_stop"))
    return rows.join(broadcast_if_small(stops), source, "left").filter(F.col("_stop").isNull() | (F.col(place) <= F.col("_stop"))).drop("_stop")


def numbered_within(rows: DataFrame, source: str, order: Sequence[str], place: str) -> DataFrame:
    """The rows of each source numbered from 1 in the order of columns that tell its rows apart, without sorting a source in one task.

    A sort by ranges puts the rows of a source side by side; each task numbers its rows, and a source that
    spans several ranges goes on from the counts of the ranges before.
    """
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(rows.repartitionByRange(parts, source, *order).sortWithinPartitions(source, *order).withColumn("_part", F.spark_partition_id()))
    within = W.partitionBy("_part", source)
    sizes = ranged.groupBy(source, "_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(W.partitionBy(source).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    numbered = ranged.withColumn("_n", F.row_number().over(within.orderBy(*order)))
    same = numbered[source].eqNullSafe(before[source]) & (numbered["_part"] == before["_part"])
    return numbered.join(before.filter(F.col("_before") > 0), same, "left").select(*(numbered[c] for c in rows.columns), (F.col("_n") + F.coalesce("_before", F.lit(0))).alias(place))


def too_old(rows: DataFrame, source: str, place: str, time: str, since: datetime, margin_days: int = 45, length: int = 3) -> DataFrame:
    """A newest-first listing of each source, read until ``length`` consecutive rows are older than ``since`` less a margin.

    A row without a time is not old.
    """
    limit = F.lit(since - timedelta(days=margin_days))
    return until_run(rows, source, place, F.coalesce(F.col(time) < limit, F.lit(False)), length)


def unknown_rows(rows: DataFrame, known: DataFrame, source: str, place: str, id: str, overlap: int, same_source: bool = False) -> DataFrame:
    """New rows of each source, read until ``overlap`` consecutive ids are already known (of the same source, if asked for)."""
    if same_source:
        ids = known.select(F.col(source).alias("_source"), F.col(id).alias("_known")).distinct()
        marked = rows.join(ids, (rows[id] == F.col("_known")) & (rows[source] == F.col("_source")), "left").drop("_source")
    else:
        ids = known.select(F.col(id).alias("_known")).distinct()
        marked = rows.join(ids, rows[id] == F.col("_known"), "left")
    return until_run(marked, source, place, F.col("_known").isNotNull(), overlap).filter(F.col("_known").isNull()).drop("_known")


def frontier(rows: DataFrame, source: str, place: str, id: str, time: str) -> DataFrame:
    """Per source: its number of entries, the id at its head (of equal places the least), and when it was last seen."""
    head = F.min(F.when(F.col(place).isNotNull(), F.struct(F.col(place), F.col(id).alias("head"))))["head"]
    return rows.groupBy(source).agg(F.count_distinct(id).alias("known_entries"), head.alias("head_id"), F.max(time).alias("verified_at"))


def coverage(entries: DataFrame, observations: DataFrame, source: str, snapshot: str, id: str, declared: str, time: str) -> DataFrame:
    """How much of each source a snapshot holds: distinct entries listed, the number declared, and those that the snapshot before listed too.

    ``coverage`` is complete (as many as declared, or more), partial, missing (nothing is listed) or unknown
    (no number is declared); ``verified_at`` is the latest time of the snapshot's observations. Of several
    declared numbers the largest counts. Sources that were not observed have no row.
    """
    distinct = entries.groupBy(source, snapshot, id).agg(F.lit(1).alias("_one")).filter(F.col(id).isNotNull())
    listed = distinct.groupBy(source, snapshot).agg(F.count(F.lit(1)).alias("listed"))
    # A pair's snapshots and the ones behind them meet by adding up, so that nothing is joined with itself.
    met = distinct.select(source, id, F.explode(F.array(F.struct(F.col(snapshot).alias("s"), F.lit(True).alias("own")), F.struct((F.col(snapshot) + 1).alias("s"), F.lit(False).alias("own")))).alias("x"))
    both = met.groupBy(source, id, F.col("x.s").alias(snapshot)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 2)
    overlap = both.groupBy(source, snapshot).agg(F.count(F.lit(1)).alias("overlap"))
    told = observations.groupBy(source, snapshot).agg(F.max(declared).alias("declared"), F.max(time).alias("verified_at"))
    rows = told.join(listed, [source, snapshot], "left").join(overlap, [source, snapshot], "left").na.fill(0, ["listed", "overlap"])
    state = F.when(F.col("declared").isNull(), "unknown").when(F.col("listed") >= F.col("declared"), "complete").when(F.col("listed") == 0, "missing").otherwise("partial")
    return rows.select(source, snapshot, "listed", "declared", "overlap", "verified_at", state.alias("coverage"))
