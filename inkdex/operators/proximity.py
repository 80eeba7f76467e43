"""How close the query's tokens stand to each other in a document.

With P_i the places of token i and L_i its length in bytes, the proximity is the least sum of |P_(i+1) - P_i - L_i|
over one place per token. It only steps to the two places around the current one (the last one before it, or
the first of all, and the next), which is exact for different tokens; for repeated ones it defines the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_FAR = np.iinfo(np.int64).max


def best_places(places: list[list[int]], sizes: list[int]) -> tuple[int, list[int]]:
    """(proximity, chosen place per token) for ascending places per token and the tokens' byte lengths.

    Of equal sums the earliest place of the last token wins, then that of the one before. A token without places gives
    (-1, []).
    """
    if not places or not all(places):
        return -1, []
    here, cost, back = np.asarray(places[0], np.int64), np.zeros(len(places[0]), np.int64), []
    for size, nxt in zip(sizes, places[1:]):
        there = np.asarray(nxt, np.int64)
        low = np.maximum(np.searchsorted(there, here, "left") - 1, 0)
        # both steps from every reached place, as (target, cost, source), so that one sort finds each target's best
        source = np.tile(np.arange(len(here)), 2)
        target = np.concatenate((low, low + 1))
        fine = (target < len(there)) & (cost[source] != _FAR)
        source, target = source[fine], target[fine]
        total = cost[source] + np.abs(there[target] - here[source] - size)
        order = np.lexsort((source, total, target))
        target, total, source = target[order], total[order], source[order]
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        cost, came = np.full(len(there), _FAR), np.zeros(len(there), np.int64)
        cost[target[first]], came[target[first]] = total[first], source[first]
        back.append(came)
        here = there
    at = int(cost.argmin())
    least, chosen = int(cost[at]), []
    for k in range(len(places) - 1, -1, -1):
        chosen.append(int(places[k][at]))
        if k:
            at = int(back[k - 1][at])
    return least, chosen[::-1]


def add_proximity(df: DataFrame, tokens: list[str], locations: str = "token_locations") -> DataFrame:
    """Adds token_proximity int and token_snippet_locations array<int>; null where a token has no places, or without tokens.

    ``locations``: array<array<int>> in the order of ``tokens``. Only the documents that a lookup left come here.
    """
    sizes = [len(t.encode()) for t in tokens]

    def run(batches):
        for b in batches:
            table = pa.Table.from_batches([b])
            found = [best_places(x or [], sizes) for x in b.column(b.schema.get_field_index(locations)).to_pylist()]
            near = pa.array([p if s else None for p, s in found], pa.int32())
            snippet = pa.array([s or None for _, s in found], pa.list_(pa.int32()))
            yield from table.append_column("token_proximity", near).append_column("token_snippet_locations", snippet).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, token_proximity int, token_snippet_locations array<int>")
