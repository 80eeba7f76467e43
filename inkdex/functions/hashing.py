"""Murmur3 (x86, 32 bits, seed 1) of byte strings, all keys of a batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published hash function.
C1, C2, M, N, F1, F2 = 0xCC9E2D51, 0x1B873593, 5, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
SEED = 1


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _scramble(x: np.ndarray) -> np.ndarray:
    return _rotate(x * np.uint32(C1), 15) * np.uint32(C2)


def murmur3_batch(keys: list[bytes], seed: int = SEED) -> np.ndarray:
    """The hashes as uint32; keys are laid out in one zero-padded matrix and walked word by word together."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    hashes = np.full(len(keys), seed, np.uint32)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max()) if len(keys) else 0
    step = max(1, (1 << 22) // max(longest, 1))  # keys per matrix, so that long keys don't blow it up
    for lo in range(0, len(keys), step):
        part = order[lo : lo + step]
        width = int(sizes[part[0]]) // 4 * 4 + 4
        matrix = np.frombuffer(b"".join(keys[k].ljust(width, b"\0") for k in part), np.uint32).reshape(len(part), -1)
        h, n = hashes[part], sizes[part]
        for w in range(width // 4):
            whole = n >= 4 * w + 4
            mixed = h ^ _scramble(matrix[:, w])
            rest = (n > 4 * w) & ~whole  # the tail word: padded with zeros, mixed in but not stirred
            h = np.where(whole, _rotate(mixed, 13) * np.uint32(M) + np.uint32(N), np.where(rest, mixed, h))
        h ^= n.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(F1)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(F2)
        hashes[part] = h ^ (h >> np.uint32(16))
    return hashes


def murmur3(text: Column) -> Column:
    """The hash of a string's UTF-8 bytes as a bigint (it is unsigned); null for null."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        there = texts.notna().to_numpy()
        out = np.zeros(len(texts), np.int64)
        out[there] = murmur3_batch([t.encode() for t in texts[there]]).astype(np.int64)
        return pd.Series(out, index=texts.index, dtype="Int64").where(there)

    return run(text)


def storage_shard(doc_id: Column, shards: int) -> Column:
    """Shard of a stored document: by the hash of '%d' and its id. The format string is part of the key, as it stands."""
    return F.pmod(murmur3(F.concat(F.lit("%d"), doc_id.cast("string"))), F.lit(shards)).cast("int")


def index_shard(doc_id: Column, content: Column, shards: int) -> Column:
    """Shard of an indexed document: by the hash of '%d%s', its id and its content."""
    return F.pmod(murmur3(F.concat(F.lit("%d%s"), doc_id.cast("string"), F.coalesce(content, F.lit("")))), F.lit(shards)).cast("int")
