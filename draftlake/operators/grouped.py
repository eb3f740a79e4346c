"""Small groups through one Python function, many to a batch.

``groupBy().applyInPandas`` sends every group as a batch of its own, which costs more than
the work on a group of some hundred rows.  Here a partition is sorted by its keys and read in
batches of the usual size; groups are cut from them as arrays, results leave together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.session import spread_rows

FLUSH_ROWS = 50_000


def _differs(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where keys differ; a null equals a null."""
    return (now != before) & ~(pd.isna(now) & pd.isna(before))


def grouped(df: DataFrame, keys: Sequence[str], fn: Callable[[dict[str, np.ndarray]], dict], schema: str, flush: int | None = None, dense: bool = False) -> DataFrame:
    """``fn`` over the rows of every group, as arrays by column; it returns columns, or none at all.

    A column of the result may be one value for all of its rows.  A task holds one group and
    FLUSH_ROWS rows of results (``flush``, where rows are wide), or one group's more.  ``dense``
    rows mean much work for few bytes, so small exchanges are not joined to few tasks.
    """
    columns, keys = df.columns, list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []  # pieces of the group that may go on
        out, load = [], 0

        def close() -> None:
            nonlocal held, load
            own = held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in columns}
            held, found = [], fn(own)
            size = max((len(v) for v in found.values() if isinstance(v, np.ndarray)), default=0)
            if size:
                out.append({c: v if isinstance(v, np.ndarray) else np.full(size, v, object) for c, v in found.items()})
                load += size

        def given() -> pd.DataFrame:
            nonlocal out, load
            whole = pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})
            out, load = [], 0
            return whole

        for pdf in batches:
            if not len(pdf):
                continue
            values = {c: pdf[c].to_numpy() for c in columns}
            cut = np.zeros(len(pdf), bool)
            for k in keys:
                v = values[k]
                cut[1:] |= _differs(v[1:], v[:-1])
                cut[:1] |= _differs(v[:1], held[-1][k][-1:]) if held else True
            starts = np.flatnonzero(cut)
            if len(starts) == 0 or starts[0] > 0:  # the open group goes on
                first = starts[0] if len(starts) else len(pdf)
                held.append({c: v[:first] for c, v in values.items()})
            for at, stop in zip(starts, np.append(starts[1:], len(pdf)), strict=False):
                if held:
                    close()
                held.append({c: v[at:stop] for c, v in values.items()})
                if load >= (flush or FLUSH_ROWS):
                    yield given()
        if held:
            close()
        if out:
            yield given()

    dealt = (spread_rows(df, *keys) if dense else df.repartition(*[F.col(k) for k in keys])).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, schema)
