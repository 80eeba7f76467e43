"""Heavy-light term frequencies: exact local counter arrays for the few heavy terms, shuffled rows for the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkdex.operators.skew import LEAST_SHARE, hot_keys, hot_share

#: Bits of a block of neighbouring records, whose repeats are told apart in one array.
BLOCK = 16
#: Heavy rows that a task packs together.
CHUNK = 1 << 20


def _packed(batches):
    """(term number, block, records within the block, weights) of heavy rows: each task takes its own repeats out first.

    A null record names the term and no more: it has an empty block.
    """
    held, n = [], 0

    def rows():
        cols = [np.concatenate(x) for x in zip(*held)]
        order = np.lexsort((-cols[2], cols[1], cols[0]))
        i, r, w = (c[order] for c in cols)
        new = np.concatenate(([True], (i[1:] != i[:-1]) | (r[1:] != r[:-1])))  # the greatest weight of repeats comes first
        i, r, w = i[new], r[new], w[new]
        b = r >> BLOCK
        first = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (b[1:] != b[:-1]))))
        offsets = np.append(first, len(i))
        low, w = (r & ((1 << BLOCK) - 1)).astype("<u2"), w.astype("<f8")
        binary = lambda x: pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((offsets * x.itemsize).astype(np.int32)), pa.py_buffer(x.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(i[first]), pa.array(b[first]), binary(low), binary(w)], ["i", "b", "r", "w"])

    alone: set[int] = set()
    for batch in batches:
        there = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        i = batch.column(0).to_numpy()
        alone.update(np.unique(i[~there]).tolist())
        if there.any():
            kept = batch.filter(pa.array(there))
            held.append([kept.column(0).to_numpy(), kept.column(1).to_numpy(), kept.column(2).to_numpy()])
            n += kept.num_rows
        if n > CHUNK:
            yield rows()
            held, n = [], 0
    if held:
        yield rows()
    if alone:
        names = sorted(alone)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([0] * len(names), pa.int64()), pa.array([b""] * len(names)), pa.array([b""] * len(names))], ["i", "b", "r", "w"])


def _counted(terms: int):
    """Counts a task's blocks, which come in order, into arrays of one counter a term."""

    def run(batches):
        documents, occurrences, met = np.zeros(terms, np.int64), np.zeros(terms), np.zeros(terms, bool)
        weight, at = np.full(1 << BLOCK, -1.0), None

        def close():
            there = weight >= 0
            documents[at[0]] += there.sum()
            occurrences[at[0]] += weight[there].sum()
            weight.fill(-1.0)

        for b in batches:
            for i, block, r, w in zip(*(c.to_pylist() for c in b.columns)):
                if (i, block) != at:
                    if at is not None:
                        close()
                    at = (i, block)
                met[i] = True
                low = np.frombuffer(r, "<u2")
                weight[low] = np.maximum(weight[low], np.frombuffer(w, "<f8"))  # a record occurs once in a packed row
        if at is not None:
            close()
        own = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(documents[own]), pa.array(occurrences[own])], ["_i", "d", "o"])

    return run


def term_counts(df: DataFrame, term: str, record: str, weight: str, *, heavy_share: float | None = None) -> DataFrame:
    """Occurrences and records of every distinct term.

    A term occurs in the distinct records of its rows; its occurrences are the sum of ``weight`` over them, of repeats
    (rows of equal term and record) the greatest. Null and empty terms are left out; a null, NaN or negative weight
    counts 0; a null record counts neither as a record nor towards the occurrences. Terms are compared by exact
    characters; an empty table gives no rows. Result: (term, documents bigint, occurrences double).

    Heavy terms (a sketch of all rows finds every term with ``heavy_share`` of them; None: by the session's tasks, see
    ``skew.hot_share``) are numbered and broadcast, at most 1.25 / heavy_share + 8 of them with a bounded length. Their
    rows never move as rows: a task takes its own repeats out and packs the rest by term and block of 65,536
    neighbouring records, 10 bytes a record before compression. Blocks of a kind meet in one task, which takes out
    repeats across tasks in an array of the block's records and counts them into exact arrays of one counter a term;
    what leaves a task is one row a term. Light rows are shuffled by term. The two count tables are then united.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    rows = df.select(F.col(term).alias("_t"), F.col(record).cast("bigint").alias("_r"), F.when((w > 0) & ~F.isnan(w), w).otherwise(F.lit(0.0)).alias("_w")).where("_t <> ''")
    heavy = hot_keys(rows, "_t", max(heavy_share or hot_share(df), LEAST_SHARE))
    names = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(heavy)), "_i int, _t string"))  # bounded by heavy_share
    light = rows.join(names.select("_t"), "_t", "left_anti") if heavy else rows
    # one exchange by term serves both groupings; a light term is less than half of what a task gets
    light = light.repartition("_t").groupBy("_t", "_r").agg(F.max("_w").alias("_w"))
    light = light.groupBy("_t").agg(F.count("_r").alias("documents"), F.coalesce(F.sum(F.when(F.col("_r").isNotNull(), F.col("_w"))), F.lit(0.0)).alias("occurrences"))
    light = light.select(F.col("_t").alias("term"), "documents", "occurrences")
    if not heavy:
        return light
    packed = rows.join(names, "_t").select("_i", "_r", "_w").mapInArrow(_packed, "i int, b bigint, r binary, w binary")
    placed = packed.repartition("i", "b").sortWithinPartitions("i", "b")
    counts = placed.mapInArrow(_counted(len(heavy)), "_i int, d bigint, o double").groupBy("_i").agg(F.sum("d").alias("documents"), F.sum("o").alias("occurrences"))
    return light.unionByName(counts.join(names, "_i").select(F.col("_t").alias("term"), "documents", "occurrences"))


def verdicts(counts: DataFrame, common: Column, rare: Column) -> DataFrame:
    """``counts`` with ``verdict`` 'common' or 'rare' (the first that holds); terms that are neither are left out."""
    return counts.withColumn("verdict", F.when(common, "common").when(rare, "rare")).where(F.col("verdict").isNotNull())
