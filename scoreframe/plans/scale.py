"""Plan helpers for data that is large or badly distributed.

``running_totals`` replaces a window over a group of unknown size, ``cut``
ends a lineage safely, and ``fits`` decides whether a table may be broadcast.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Largest lookup table that is shipped to every executor.
BROADCAST_ROWS = 1_000_000
# Rows of a hot key that one task joins, about.
ROWS_PER_SALT = 1_000_000


def _conf(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    return value or None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own:
    one for the whole session, removed when the program ends.
    """
    context = spark.sparkContext
    folder = _conf(spark, "spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="scoreframe-")
        atexit.register(shutil.rmtree, _OWN[context.applicationId], ignore_errors=True)
    return _OWN[context.applicationId]


# The folder of each local session that names none.
_OWN: dict[str, str] = {}


# Scratch folders of this program, each removed once when it ends.
_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's scratch folder under the shared folder.

    The folder goes when the program ends. Until then its tables can be read by
    any frame that was built on them; what is to stay gets a path of its own.
    """
    context = spark.sparkContext
    root = f"{shared_folder(spark).rstrip('/')}/scratch-{context.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH.add(root)
        atexit.register(_remove, context._jvm, root)
    return f"{root}/{name}-{os.urandom(8).hex()}"


def _remove(jvm, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # the JVM went first; the folder is the cluster's to clean
        pass


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame so later reads do not recompute it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the frame has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def balance(scan: DataFrame, tasks: int | None = None) -> DataFrame:
    """Spread a scan over at least ``tasks`` tasks (default: the free cores).

    For costly row work on few or unsplittable files. A scan that already has
    enough tasks is returned as it is, without a shuffle. Call it on a scan
    only: counting the tasks of a plan with shuffles would run them.
    """
    wanted = tasks or scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= wanted else scan.repartition(wanted)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Add ``<name>_before``: the sum over earlier rows of the same group.

    "Earlier" means smaller in ``order`` (ascending, nulls first) within the
    ``by`` group; rows must be unique in ``by`` + ``order``. A window over the
    group would sort a hot group in one task. Here the rows are
    range-partitioned, so a hot group spans many tasks: sums run inside each
    range, and one small window over range totals (one row per range and group
    in it) supplies the offset. The ranges are written out once, because two
    evaluations of a range partitioner need not cut at the same place. After
    that rows are shuffled once more, by range and a hash of the group, which
    serves the sums inside the range and the join with its offset.
    """
    keys = [*by, *order]
    # Without a number AQE merges neighbouring small ranges.
    number = [] if partitions is None else [partitions]
    values = {f"__{name}": value for name, value in sums.items()}
    ranged = cut(
        df.withColumns(values)
        .repartitionByRange(*number, *[F.col(k).asc_nulls_first() for k in keys])
        .withColumns({"__range": F.spark_partition_id(), "__group": F.xxhash64(F.lit(0), *by)})
    )
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    within = Window.partitionBy("__range", "__group", *by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*by, "__group", "__range")
        .agg(*[F.sum(f"__{name}").alias(f"__{name}") for name in sums])
        .select(
            *[F.col(k).alias(f"__by_{k}") for k in by],
            F.col("__range").alias("__at"), F.col("__group").alias("__of"),
            *[F.coalesce(F.sum(f"__{name}").over(earlier), F.lit(0)).alias(f"__{name}_off")
              for name in sums],
        )
    )
    local = ranged.repartition("__range", "__group").withColumns(
        {f"__{name}_in": F.coalesce(F.sum(f"__{name}").over(within), F.lit(0)) for name in sums}
    )
    same = [F.col("__range") == F.col("__at"), F.col("__group") == F.col("__of")]
    same += [F.col(k).eqNullSafe(F.col(f"__by_{k}")) for k in by]
    return local.join(offsets, same, "inner").select(
        *df.columns,
        *[(F.col(f"__{name}_off") + F.col(f"__{name}_in")).alias(f"{name}_before")
          for name in sums],
    )


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Inner or left semi join of many rows with one lookup row per key.

    The lookup is materialised and its size is known before the plan is made:
    small ones are broadcast and the rows stay where they are, large ones meet
    the rows in a salted join.
    """
    known = cut(lookup)
    if fits(known):
        return rows.join(F.broadcast(known), list(on), how)
    return spread_join(rows, known, on, spread, how=how)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    rows_per_salt: int = ROWS_PER_SALT,
    how: str = "inner",
) -> DataFrame:
    """Inner or left semi equi-join for a left side whose keys may be hot.

    Keys with more than ``rows_per_salt`` left rows are counted first; there
    are at most ``rows / rows_per_salt`` of them, so their list is broadcast.
    Such a key is spread over as many tasks as its rows call for: left rows get
    a salt from their ``spread`` columns, and the right side's row is copied
    once per salt of its key. All other keys have one salt. The salt is a hash,
    not a random number: a retried task must send every row to the same place.
    """
    hot = F.broadcast(
        cut(
            left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") > rows_per_salt)
            .select(*on, F.ceil(F.col("__n") / rows_per_salt).alias("__salts"))
        )
    )

    def salts(side: DataFrame) -> DataFrame:
        one = F.coalesce("__salts", F.lit(1).cast("long"))
        return side.join(hot, list(on), "left").withColumn("__salts", one)

    salted = salts(left).withColumn("__salt", F.pmod(F.xxhash64(*spread), F.col("__salts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1)
    copies = salts(right).withColumn("__salt", F.explode(every)).drop("__salts")
    return salted.join(copies, [*on, "__salt"], how).drop("__salt", "__salts")
