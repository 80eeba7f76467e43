"""Relevance as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkdex.model import BM25Parameters


def idf(n_docs: Column, df: Column) -> Column:
    """Smoothed inverse document frequency: log2(n_docs / df + 1)."""
    return F.log2(n_docs.cast("double") / df.cast("double") + 1)


def bm25_term(tf: Column, df: Column, length: Column, n_docs: Column, average: Column, p: BM25Parameters) -> Column:
    """A term's part of the score; 0 without occurrences or where no document has a length."""
    f = tf.cast("double")
    norm = f + p.k1 * (1 - p.b + p.b * length / average)
    return F.when((f > 0) & (average != 0), idf(n_docs, df) * f * (p.k1 + 1) / norm).otherwise(F.lit(0.0))


def bm25_values(tf: np.ndarray, df: int, length: np.ndarray, n_docs: int, average: float, p: BM25Parameters) -> np.ndarray:
    """The same of arrays, for one term."""
    if not average:
        return np.zeros(len(tf))
    norm = tf + p.k1 * (1 - p.b + p.b * length / average)
    return np.where(tf > 0, math.log2(n_docs / df + 1) * tf * (p.k1 + 1) / np.where(tf > 0, norm, 1.0), 0.0)


def bm25_scorer(docs: DataFrame) -> Column:
    """The default scorer: one score, the BM25. Keeps every document."""
    return F.array(docs["bm25"])
