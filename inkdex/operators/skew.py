"""Per-key results where a few keys own most rows: sketch the hot keys, salt them, merge partials."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkdex.runtime import partitions

#: Items that the frequent-items sketch tracks at least; its error is about 3.5 / tracked of all rows.
TRACKED = 20_000
#: A key longer than this many bytes is never put into side data; where it must be told there, its fingerprint is.
KEY_BYTES = 1_024
#: Keys below this share of the rows are never told apart as hot, so that the list of hot ones stays bounded (2,508 at most).
LEAST_SHARE = 0.0005


def side(key: Column) -> Column:
    """What stands for a key in side data: the key itself, or a fingerprint of one that is too long.

    A fingerprint that meets another key only makes that key one more to be salted and counted, by its whole value.
    """
    return F.when(F.octet_length(key) <= KEY_BYTES, key).otherwise(F.md5(key))


@dataclass(frozen=True)
class Hot:
    """``rows`` of the table as it stands, null keys included, and of each hot key about how many are its own."""

    rows: int = 0
    keys: dict[str, int] = field(default_factory=dict)


def hot_share(df: DataFrame) -> float:
    """The share from which a key is hot: half of what a task gets if rows are dealt evenly, 0.5 % at most."""
    return min(0.005, max(0.5 / partitions(df.sparkSession), LEAST_SHARE))


def hot_counts(df: DataFrame, key: str, share: float) -> Hot:
    """Every value of the string column ``key`` that may hold ``share`` of its non-null rows or more.

    One pass with a mergeable frequent-items sketch; no shuffle of the rows. The sketch may add keys that are just
    below the share, it omits none above it (its error is far below ``share``). At most ``1.25 / share + 8`` values
    come to the driver, so the result is bounded whatever the data. Keys beyond ``KEY_BYTES`` are named by their
    fingerprints (see ``side``). Null keys are left out; an empty table has none.
    """
    most = int(1.25 / share) + 8
    if share < LEAST_SHARE:
        raise ValueError(f"share must be at least {LEAST_SHARE}")
    row = df.select(side(F.col(key)).alias("k")).agg(F.count(F.lit(1)).alias("rows"), F.count("k").alias("n"), F.expr(f"approx_top_k(k, {most}, {max(TRACKED, most * 40)})").alias("top")).first()
    if not row or not row.n or row.top is None:
        return Hot(row.rows if row else 0)
    return Hot(row.rows, {x["item"]: x["count"] for x in row.top if x["item"] is not None and x["count"] >= share * row.n * 0.999})


def hot_keys(df: DataFrame, key: str, share: float) -> list[str]:
    """The keys of ``hot_counts`` that are no longer than ``KEY_BYTES``, by themselves."""
    return list(hot_counts(df.where(F.octet_length(key) <= KEY_BYTES), key, share).keys)


def with_salt(df: DataFrame, key: Column, record: Column, hot: Hot, salts: int | None = None) -> DataFrame:
    """Adds ``_salt``: 0 for an ordinary key, else one of as many values as make a hot key's shares half a task each.

    ``salts``: so many for every hot key instead. The salt is a hash of the record, not ``rand()``: a task that runs
    again deals the same rows to the same salt, and repeats of a record meet each other there.
    """
    tasks = partitions(df.sparkSession)
    by: dict[int, list[str]] = {}
    for k, n in hot.keys.items():
        want = salts or max(2, -(-2 * n * tasks // max(hot.rows, 1)))
        by.setdefault(1 << (want - 1).bit_length(), []).append(k)  # powers of two, so that there are few cases
    salt = F.lit(0)
    for many, keys in by.items():
        salt = F.when(side(key).isin(keys), F.pmod(F.xxhash64(record, F.lit(7)), F.lit(many)).cast("int")).otherwise(salt)
    return df.withColumn("_salt", salt)


def _clean(df: DataFrame, key: str, record: str, weight: str) -> DataFrame:
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    return df.select(F.col(key).alias("_key"), F.col(record).alias("_rec"), F.when((w > 0) & ~F.isnan(w), w).otherwise(F.lit(0.0)).alias("_w")).where("_key <> ''")


def top_records_per_key(df: DataFrame, key: str, record: str, weight: str, k: int, *, min_share: float = 0.0, salts: int | None = None, exact_repeats: bool = False) -> DataFrame:
    """The ``k`` distinct records of greatest weight of each key, whatever share of the rows a key holds.

    Stage 1 ranks within (key, salt), so a hot key is ranked by many tasks and each of them, map side first, lets
    through no more than k records; stage 2 ranks those few per key. ``min_share``: only keys with at least this
    share of *all* rows of ``df`` (rows as they stand, null keys and repeats included).

    Null and empty keys have no result; null, NaN or negative weights count 0; a null record is a record of its own,
    last among equals; ties go to the smaller record. Of a record's repeats under a key the greatest weight counts, at
    the price of a shuffle of all rows; ``exact_repeats``: they are known to carry equal weights, so that they can
    share a rank and are pruned before the shuffle. Result: (key, record, weight double, rank int).
    """
    hot = hot_counts(df, key, max(min(hot_share(df), min_share or 1.0), LEAST_SHARE))
    rows = _clean(df, key, record, weight)
    if min_share:
        rows = rows.where(side(F.col("_key")).isin(list(hot.keys))) if hot.keys else rows.where(F.lit(False))
        sums = with_salt(rows, F.col("_key"), F.col("_rec"), hot, salts).groupBy("_key", "_salt").agg(F.count(F.lit(1)).alias("c"))
        big = sums.groupBy("_key").agg(F.sum("c").alias("c")).where(F.col("c") >= F.lit(min_share) * F.lit(hot.rows))
        rows = rows.join(F.broadcast(big.select("_key")), "_key", "left_semi")  # no more rows than 1 / min_share
    order = (F.col("_w").desc(), F.col("_rec").asc_nulls_last())
    rows = with_salt(rows, F.col("_key"), F.col("_rec"), hot, salts)
    if not exact_repeats:
        rows = rows.repartition("_key", "_salt").groupBy("_key", "_salt", "_rec").agg(F.max("_w").alias("_w"))
    # repeats share a dense rank, and Spark lets no more than k ranks of a group into the shuffle
    first = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("_key", "_salt").orderBy(*order))).where(F.col("_r") <= k)
    once = first.select("_key", "_salt", "_rec", "_w").distinct()
    last = once.withColumn("rank", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where(F.col("rank") <= k)
    return last.select(F.col("_key").alias(key), F.col("_rec").alias(record), F.col("_w").alias(weight), "rank")


def totals_per_key(df: DataFrame, key: str, record: str, weight: str, *, salts: int | None = None) -> DataFrame:
    """Rows, distinct records and summed weight of each key, hot keys spread over many tasks.

    A record counts once per key (with the greatest weight of its repeats); null, NaN or negative weights count 0, a
    null record is counted as a row but not as a record and adds no weight. Null and empty keys have no result.
    Result: (key, n_rows bigint, n_records bigint, total double).
    """
    hot = hot_counts(df, key, hot_share(df))
    rows = with_salt(_clean(df, key, record, weight), F.col("_key"), F.col("_rec"), hot, salts)
    # one shuffle by (key, salt) serves both groupings; a record lies in one salt, so distinct counts add up
    once = rows.repartition("_key", "_salt").groupBy("_key", "_salt", "_rec").agg(F.count(F.lit(1)).alias("c"), F.max("_w").alias("w"))
    part = once.groupBy("_key", "_salt").agg(F.sum("c").alias("c"), F.count("_rec").alias("d"), F.sum(F.when(F.col("_rec").isNotNull(), F.col("w"))).alias("t"))
    return part.groupBy("_key").agg(F.sum("c").alias("n_rows"), F.sum("d").alias("n_records"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("total")).withColumnRenamed("_key", key)
