"""Building blocks that keep hot keys and large groups distributed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with at least this many rows is split over several tasks, none with more rows of it than this.
HOT_KEY_ROWS = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's shared checkpoint folder.

    A machine-local folder would be lost with its machine, so a missing setting is an error, in
    local sessions as well.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there.

    The rows are computed once, the lineage ends here, and a lost executor costs nothing but
    a repeated read. Tables stay until the folder is cleaned, as checkpoints do, or until the
    block of :func:`temporary_tables` around them ends.
    """
    spark = df.sparkSession
    location = written_folder(spark)
    df.write.parquet(location)
    return spark.read.schema(df.schema).parquet(location)


def written_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    location = f"{spark.sparkContext.getCheckpointDir()}/quire-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(location)
    return location


_owners: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Drop all tables that :func:`stored` writes in the block when it ends.

    For whole jobs: what is made in the block must be written or collected in it.
    """
    owned: list[str] = []
    _owners.append(owned)
    try:
        yield
    finally:
        _owners.pop()
        for location in owned:
            path = spark._jvm.org.apache.hadoop.fs.Path(location)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(
    df: DataFrame, keys: list[str], total_rows: int, min_rows: int = HOT_KEY_ROWS
) -> DataFrame | None:
    """Keys with at least ``min_rows`` of the ``total_rows`` rows and their ``_pieces``, or None without any.

    At most ``count(df) / min_rows`` keys can qualify, which bounds the result by the
    choice of ``min_rows``: ten billion rows give no more than ten thousand keys. The counts
    are taken right away, so ``df`` should be stored or cheap.
    """
    if total_rows < min_rows:
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    found = stored(counts.filter(F.col("_rows") >= min_rows).select(*keys, pieces_of(F.col("_rows"), min_rows).alias("_pieces")))
    return None if found.isEmpty() else found


def pieces_of(rows: Column, min_rows: int) -> Column:
    """Pieces for a key of so many rows: twice as many as needed, as hashes don't split evenly."""
    return F.greatest(F.lit(2), F.ceil(2 * rows / F.lit(min_rows))).cast("int")


def hot_key_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    hot: DataFrame | None,
    spread: Column,
    how: str = "left",
) -> DataFrame:
    """Join many rows to few when the keys ``hot`` hold a large share of ``big``.

    Rows of a hot key are spread over its pieces by the hash of ``spread``, which must
    be a function of the row so that a retried task puts each row in the same piece. The
    matching rows of ``small`` are repeated per piece, those of other keys stay single.
    ``hot`` comes from :func:`hot_keys`, whose size is bounded and whose pieces follow the rows of each key; without any
    it is a plain join. ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    """
    if hot is None:
        return big.join(small, on, how)
    marked = F.broadcast(hot)
    piece = F.pmod(F.xxhash64(spread), F.col("_pieces")).cast("int")
    left = big.join(marked, on, "left").withColumn(
        "_piece", F.when(F.col("_pieces").isNotNull(), piece).otherwise(0)
    )
    all_pieces = F.sequence(F.lit(0), F.col("_pieces") - 1)
    right = small.join(marked, on, "left").withColumn(
        "_piece", F.explode(F.when(F.col("_pieces").isNotNull(), all_pieces).otherwise(F.array(F.lit(0))))
    )
    return left.drop("_pieces").join(right.drop("_pieces"), [*on, "_piece"], how).drop("_piece")


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: str | None = None,
    row_no: str = "row_no",
    before: str = "sum_before",
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Row number, and sum of ``value`` over the rows before, within each ordered group.

    No group is ever sorted by one task. The rows are range-partitioned over the whole
    ``(group, order)`` key, so a large group lies in many consecutive slices; each slice
    counts its own rows, and a small table of slice totals supplies what came before.
    ``(group, order)`` must be unique per row. ``store`` keeps the intermediate table where the
    caller can drop it; by default it is :func:`stored`.
    """
    # The slice numbers become stored data: the range bounds come from a sample and must not
    # be drawn a second time when a lost task is repeated.
    sliced = (store or stored)(
        df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id())
    )
    amount = F.col(value) if value else F.lit(0)
    totals = sliced.groupBy(*group, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(amount).alias("_amount")
    )
    # One row per slice and group: never more rows per group than there are slices.
    earlier = (
        Window.partitionBy(*group)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *group,
        "_slice",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_amount_before"),
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    counted = sliced.withColumn(row_no, F.row_number().over(inside)).withColumn(
        before,
        F.coalesce(
            F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    result = counted.join(offsets, [*group, "_slice"]).select(
        *df.columns,
        (F.col(row_no) + F.col("_rows_before")).cast("bigint").alias(row_no),
        (F.col(before) + F.col("_amount_before")).cast("bigint").alias(before),
    )
    return result if value else result.drop(before)


#: Key tables up to this size may be broadcast; larger ones are shuffled.
BROADCAST_KEY_BYTES = 64 * 1024 * 1024


def narrow_by_keys(
    big: DataFrame, keys: DataFrame, on: list[str], broadcast_bytes: int = BROADCAST_KEY_BYTES
) -> DataFrame:
    """Rows of ``big`` whose key is in ``keys``, without moving ``big`` when keys are few.

    The keys are measured right away, so they should be stored or cheap. Up to
    ``broadcast_bytes`` they are broadcast, so large rows are filtered where they are read;
    beyond that both sides are shuffled.
    """
    return big.join(_measured_keys(keys, on, broadcast_bytes), on, "left_semi")


def without_keys(
    big: DataFrame, keys: DataFrame, on: list[str], broadcast_bytes: int = BROADCAST_KEY_BYTES
) -> DataFrame:
    """Rows of ``big`` whose key is not in ``keys``; otherwise as :func:`narrow_by_keys`."""
    return big.join(_measured_keys(keys, on, broadcast_bytes), on, "left_anti")


def _measured_keys(keys: DataFrame, on: list[str], broadcast_bytes: int) -> DataFrame:
    known = keys.select(*on).distinct()
    lengths = [F.octet_length(F.col(key).cast("string")) + 16 for key in on]
    size = known.agg(F.sum(sum(lengths[1:], lengths[0]))).head()[0] or 0
    return F.broadcast(known) if size <= broadcast_bytes else known
