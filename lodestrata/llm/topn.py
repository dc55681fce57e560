"""The top N items of every group, by merging sorted runs.

1. Each partition of the input, where it lies, is a run: its rows are ordered
   by group, score and tie columns. The reader of a run knows from the places
   where groups begin how far each reaches; it takes the first N rows of a
   group and seeks to the next one, as no later row of this run can be among
   the group's N best. Nothing is shuffled before that. What is taken is
   stored, a table of runs ordered by group and score.
2. The stored runs are shuffled by group; a loser tree merges up to
   ``fan_in`` runs of a group and leaves for the next group after N outputs.
   With more runs this is repeated.

No task ever holds more of one group than ``fan_in`` times N rows, and a
group with a third of all rows lies in as many runs as there are partitions.

Defined results: ascending ties by the tie columns, nulls last in either
direction; rows with a null score are left out, rows with a null group column
form a group of their own; rows alike in score and tie columns are taken
in the order of their content hash, repeats of a row count as rows; an empty
table gives an empty table; N of 0 or less gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.shipping import ship
from lodestrata.llm.loser_tree import LoserTree
from lodestrata.shared import discard, store, store_counted

ship(__name__)


def breaks(batch: pa.RecordBatch, names: list[str], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a row differs from the one before in ``names`` (null equals null), and the last row's values."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    for name in names:
        col = batch.column(name)
        differ = pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        voids = col.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= differ | (voids[1:] != voids[:-1])
    new[0] = before is None or before != tuple(batch.column(name)[0].as_py() for name in names)
    return new, tuple(batch.column(name)[n - 1].as_py() for name in names)


def seek_groups(batches: Iterator[pa.RecordBatch], names: list[str], n: int) -> Iterator[pa.RecordBatch]:
    """Of rows in order, the first ``n`` of each group: from where a group begins, ``n`` rows, then on to where the next begins."""
    before, taken = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new, before = breaks(batch, names, before)
        begins = np.flatnonzero(new)
        if not len(begins) or begins[0] > 0:  # the group of the batch before goes on
            begins = np.concatenate([[0], begins])
            room = np.full(len(begins), n)
            room[0] = max(0, n - taken)
        else:
            room, taken = np.full(len(begins), n), 0
        ends = np.append(begins[1:], batch.num_rows)
        own = np.minimum(ends - begins, room)
        taken = int(own[-1]) + (taken if len(begins) == 1 and not new[0] else 0)
        first = np.repeat(begins - (np.cumsum(own) - own), own)
        yield batch.take(pa.array(first + np.arange(int(own.sum()))))


def ordinals(col: pa.Array, falling: bool) -> list:
    """Numbers that order like the values: themselves, or dense ranks of other kinds; negated for falling; nulls last."""
    kind = col.type
    if pa.types.is_integer(kind) or (pa.types.is_floating(kind) and not pc.any(pc.is_nan(col)).as_py()):
        values = col.to_pylist()
    else:
        known = pc.rank(col, sort_keys="ascending", tiebreaker="dense").to_pylist()
        values = [r if ok else None for r, ok in zip(known, pc.is_valid(col).to_pylist())]
    return [(1, 0) if v is None else (0, -v if falling else v) for v in values]


def top_n(df: DataFrame, groups: list[str], scores: list[str], ties: list[str], n: int, fan_in: int = 32) -> DataFrame:
    """The ``n`` best rows of each group by ``scores`` descending, then ``ties`` ascending; all columns of ``df``."""
    columns = df.columns
    if n <= 0:
        return df.limit(0)
    names = {c: f"__c{i}" for i, c in enumerate(columns)}
    rows = df.toDF(*names.values())
    by, high, low = [names[c] for c in groups], [names[c] for c in scores], [names[c] for c in ties]
    for s in high:
        rows = rows.filter(F.col(s).isNotNull())
    plainable = [c for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
    rows = rows.withColumn("mix", F.xxhash64(*plainable)).withColumn("run", F.spark_partition_id())
    order = [*[F.col(s).desc() for s in high], *[F.col(t).asc_nulls_last() for t in low], "mix"]
    falling = len(high)
    keyed = [*high, *low, "mix"]

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return seek_groups(batches, by, n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, group, run and score; a group's rows are held until the next group begins."""
        own = ["part", *by]
        held: list[pa.RecordBatch] = []
        before = None

        def close() -> list[pa.RecordBatch]:
            group = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            which = group.column("run").to_numpy()
            cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
            if len(cuts) == 2:  # a single run is in order
                return group.slice(0, n).to_batches()
            keys = list(zip(*(ordinals(group.column(c).combine_chunks(), i < falling) for i, c in enumerate(keyed))))
            tree, taken = LoserTree([keys[a:b] for a, b in zip(cuts, cuts[1:])]), []
            while len(taken) < n and (x := tree.pop()) is not None:
                taken.append(cuts[x[0]] + x[1])
            return group.take(pa.array(taken, pa.int64())).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            new, before = breaks(batch, own, before)
            edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
            if edges[0] > 0:
                held.append(batch.slice(0, edges[0]))
            for a, b in zip(edges, edges[1:]):
                if held:
                    yield from close()
                held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    runs = rows.sortWithinPartitions(*by, *order)
    best, at, seen = store_counted(runs.mapInArrow(seek, runs.schema), "runs", runs=F.max("run"))
    left = (seen["runs"] or 0) + 1
    while True:
        parted = best.withColumn("part", F.floor(F.col("run") / fan_in).cast("int"))
        laid = parted.repartition("part", *by).sortWithinPartitions("part", *by, "run", *order)
        merged = laid.mapInArrow(merge, laid.schema).withColumn("run", F.col("part")).drop("part")
        left = -(-left // fan_in)
        if left <= 1:
            return merged.select(*[F.col(names[c]).alias(c) for c in columns])
        best, now = store(merged, "runs")
        discard(df.sparkSession, at)
        at = now
