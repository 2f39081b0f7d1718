"""Joins of many rows to one record per group, however many rows a group has.

Joins on other keys are left to Spark: its adaptive execution splits the rows of a hot key
where the join's result is shuffled again, as is the case in this package.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evalweave.storage import materialize

# Rows of a group that a task may get; a larger group is dealt over several tasks.
ROWS_PER_SALT = 100_000
# Rows that a task of ``spread_join`` gets, of both sides; adaptive execution would merge more,
# since it measures compressed bytes.
ROWS_PER_TASK = 500_000
# Ranges of key hashes in which ``spread_join`` counts rows.
_BUCKETS = 4096
# A table with one record per group is broadcast up to so many bytes, measured before the
# join is chosen; above it the join is salted.
MAX_BYTES = 16 << 20


def _salt(salt_by: Sequence[str], salts: Column) -> Column:
    return F.pmod(F.xxhash64(*salt_by), salts).cast("int")


def _key(df: DataFrame, on: Sequence[str]) -> Column:
    """One key of the columns ``on``. As all its fields may be missing, the keys of two tables
    have one type, and a table partitioned by its key needs no cast and no other shuffle.
    """
    kind = T.StructType([T.StructField(c, df.schema[c].dataType) for c in on])
    return F.struct(*on).cast(kind).alias("_key")


def group_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, n: int | None = None
) -> DataFrame:
    """Equi-join on ``on`` where a missing key value equals a missing key value.

    The keys are compared as one struct, which can be hashed and sorted like any other
    key but is never NULL itself. Rows of groups without a name are therefore kept. With
    ``n`` above 1, both sides are sorted in that many tasks. Only the right one is partitioned
    here: semi joins would be moved below a partitioning of the left one, which follows anyway.
    """
    rest = [c for c in right.columns if c not in on]
    groups = right.select(_key(right, on), *rest)
    if n is not None and n > 1:
        groups = groups.repartition(n, "_key").hint("merge")
    return left.withColumn("_key", _key(left, on)).join(groups, "_key", how).drop("_key")


def group_salts(rows: DataFrame, on: Sequence[str], rows_per_salt: int | None = None) -> DataFrame:
    """``on`` and ``_salts`` of the groups with more rows than a task should get.

    Rows are counted per group, which adds up within tasks first. There is one record for
    every ``rows_per_salt`` rows at most, so the table is small beside the rows.
    """
    most = rows_per_salt or ROWS_PER_SALT
    sizes = rows.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    return sizes.select(*on, F.ceil(F.col("_n") / most).cast("int").alias("_salts"))


def salted_join(
    rows: DataFrame,
    groups: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    rows_per_salt: int | None = None,
    counted: DataFrame | None = None,
    n: int | None = None,
) -> DataFrame:
    """Join many ``rows`` to a table with one record per group (model, run, ...).

    Every group gets as many salts as its measured size asks for, ``rows_per_salt`` rows each;
    its record is repeated for them and every row picks one, so a group with a third of all
    rows is spread over many tasks and other groups are not copied. ``salt_by`` names columns
    that tell the rows of a group apart. ``how`` is ``inner``, ``left``, ``left_semi`` or
    ``left_anti``. ``rows`` is read twice. ``counted`` names the rows of all groups that may
    need salts, if fewer than all; ``n`` fixes the number of the join's tasks.
    """
    salts = materialize(
        group_salts(rows if counted is None else counted, on, rows_per_salt), "salts"
    )
    if fits(salts):
        salts = F.broadcast(salts)
    number = F.coalesce("_salts", F.lit(1))
    copies = group_join(groups, salts, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), number - 1))
    )
    salted = group_join(rows, salts, on, "left").withColumn("_salt", _salt(salt_by, number))
    joined = group_join(salted.drop("_salts"), copies.drop("_salts"), [*on, "_salt"], how, n)
    return joined.drop("_salt")


def spread_join(
    rows: DataFrame,
    groups: DataFrame,
    n_groups: int,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str,
) -> DataFrame:
    """Join ``rows`` to about ``n_groups`` records of groups, ``ROWS_PER_TASK`` of them a task.

    The number of tasks follows the counted rows, so that what a task sorts does not grow with
    the tables. Adaptive execution neither merges nor splits them; rows are therefore counted by
    ranges of key hashes, and if a range holds a key with more rows than a task should get, the
    join is salted. ``rows`` is read twice, and once more if there is such a key.
    """
    bucket = F.pmod(F.xxhash64(*on), F.lit(_BUCKETS))
    counts = dict(rows.groupBy(bucket).count().collect())
    total = sum(counts.values())
    n = -(-(total + n_groups) // ROWS_PER_TASK)
    if n > 1:
        # Spark raises a smaller number to this one by another shuffle.
        n = max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = [b for b, c in counts.items() if c > total / _BUCKETS + ROWS_PER_TASK]
    if not heavy:
        return group_join(rows, groups, on, how, n)
    counted = rows.filter(bucket.isin(heavy))
    most = min(ROWS_PER_SALT, ROWS_PER_TASK)
    return salted_join(rows, groups, on, salt_by, how, most, counted, n)


def spread_distinct(rows: DataFrame, n_rows: int, on: Sequence[str]) -> DataFrame:
    """Distinct ``on`` of at most ``n_rows`` rows, ``ROWS_PER_TASK`` of them a task.

    Adaptive execution would cut them by compressed bytes. Rows of a key that very many share
    are made one by the tasks they come from first.
    """
    n = n_rows // ROWS_PER_TASK + 1
    keys = rows.select(*on)
    if n == 1:
        return keys.distinct()
    dealt = keys.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(n)))
    fewer = dealt.repartition(n, *on, "_salt").distinct().select(*on)
    return fewer.repartition(n, *on).distinct()


def fits(table: DataFrame, most: int | None = None) -> bool:
    """Whether a table may be broadcast, by the measured size of its values."""
    value = lambda f: F.length(F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))))
    size = sum((F.coalesce(value(f), F.lit(0)) for f in table.schema.fields), F.lit(16))
    return (table.agg(F.sum(size)).first()[0] or 0) <= (MAX_BYTES if most is None else most)


def lookup_groups(
    rows: DataFrame,
    groups: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` to one record per group without moving the rows if that is safe.

    ``groups`` is measured, not fetched: a small table is broadcast, a large one joined salted.
    It is read twice and should be cheap or a written table.
    """
    if not fits(groups):
        return salted_join(rows, groups, on, salt_by, how)
    return group_join(rows, F.broadcast(groups), on, how)
