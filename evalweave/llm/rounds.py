"""Training on all rows: shards learn side by side, and their weights are averaged.

Rows are dealt by hash into shards of bounded size, each packed into one row of a written
table in an order of its own, so that nothing depends on how the input was partitioned. In a
round, every shard moves a copy of the weights; moves are added as whole numbers, whose sums
do not depend on their order, and only weights and counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalweave.llm.shared import written

# Moves are counted in these parts of one.
_PARTS = 1 << 32
# Shards in a file of the written table.
_SHARDS_A_FILE = 8
# Outputs of a model are counted on a grid of this step, within these bounds.
STEPS, BOUND = 1024, 40
GRID = 2 * STEPS * BOUND + 1


@dataclass
class Shard:
    """Labels, parts and data of a bounded number of rows."""

    number: int
    labels: np.ndarray
    parts: np.ndarray
    rows: list[bytes]


def shards(rows: DataFrame, most_rows: int, most_bytes: int = 4 << 20) -> tuple[DataFrame, int]:
    """Pack ``(label, part, hash, data)``, a written table, into shards; also returns their number.

    A shard has about ``most_rows`` rows or ``most_bytes`` of data, dealt by ``hash``.
    """
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("data").cast("long"))).first()
    n = max(1, -(-count // most_rows), -(-(size or 0) // most_bytes))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        data = [x or b"" for x in table["data"].to_pylist()]
        found = sorted(zip(data, table["label"].to_pylist(), table["part"].to_pylist()))
        labels = np.array([x[1] for x in found], np.int8).tobytes()
        parts = np.array([x[2] for x in found], np.int8).tobytes()
        sizes = np.array([len(x[0]) for x in found], np.int32).tobytes()
        packed = [key[0].as_py(), labels, parts, sizes, b"".join([x[0] for x in found])]
        return pa.table({name: [x] for name, x in zip(names, packed)})

    names = ["number", "labels", "parts", "sizes", "data"]
    number = F.pmod("hash", F.lit(n).cast("long")).alias("number")
    dealt = rows.select(number, "label", "part", "data")
    files = n if n <= 4 * _SHARDS_A_FILE else max(4 * _SHARDS_A_FILE, -(-n // _SHARDS_A_FILE))
    packed = dealt.repartition(files, "number").groupBy("number").applyInArrow(
        pack, "number long, labels binary, parts binary, sizes binary, data binary"
    )
    return written(packed, "shards"), n


def _unpacked(batch: pa.RecordBatch) -> Iterator[Shard]:
    for i in range(batch.num_rows):
        number, labels, parts, sizes, data = (batch[k][i] for k in range(5))
        ends = np.cumsum(np.frombuffer(sizes.as_py(), np.int32), dtype=np.int64)
        data = data.as_py()
        yield Shard(
            number.as_py(),
            np.frombuffer(labels.as_py(), np.int8).astype(int),
            np.frombuffer(parts.as_py(), np.int8).astype(int),
            [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())],
        )


def summed(
    packed: DataFrame, shape: tuple[int, int], add: Callable[[np.ndarray, Shard], None]
) -> np.ndarray:
    """A table of whole numbers, to which ``add`` adds what a shard has, over all shards."""
    slots, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for shard in _unpacked(batch):
                add(total, shard)
        at = np.flatnonzero(total.any(1))
        for i in range(0, len(at), 10_000):
            some = at[i : i + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), *(pa.array(total[some, k]) for k in range(width))],
                ["slot", *names],
            )

    names = [f"c{k}" for k in range(width)]
    schema = ", ".join(["slot long", *(f"{name} long" for name in names)])
    sums = packed.mapInArrow(run, schema).groupBy("slot").agg(*(F.sum(c).alias(c) for c in names))
    # At most ``slots`` rows.
    found = sums.toArrow()
    total = np.zeros((slots, width), np.int64)
    at = found["slot"].to_numpy()
    for k, name in enumerate(names):
        total[at, k] = found[name].to_numpy()
    return total


def averaged(
    packed: DataFrame,
    n_shards: int,
    weights: np.ndarray,
    learn: Callable[[np.ndarray, Shard, int], np.ndarray],
    turns: int,
) -> np.ndarray:
    """``weights``, a table, after ``turns`` rounds of ``learn(weights, shard, turn)``.

    A row of the table is averaged over the shards that move it. A single shard takes all
    its turns in one task.
    """
    weights = weights.astype(np.float32)
    rounds = [range(turns)] if n_shards == 1 else [range(t, t + 1) for t in range(turns)]
    for own_turns in rounds:

        def add(total: np.ndarray, shard: Shard, start=weights, own_turns=own_turns) -> None:
            moved = start
            for turn in own_turns:
                moved = learn(moved.copy(), shard, turn)
            moves = np.rint((moved.astype(float) - start) * _PARTS).astype(np.int64)
            total[:, :-1] += moves
            total[:, -1] += moves.any(1)

        total = summed(packed, (len(weights), weights.shape[1] + 1), add)
        mean = total[:, :-1] / np.maximum(total[:, -1:], 1) / _PARTS
        weights = (weights + mean).astype(np.float32)
    return weights


def on_grid(values: np.ndarray) -> np.ndarray:
    """Places of outputs on the grid, rounded down."""
    return np.floor((np.clip(values, -BOUND, BOUND) + BOUND) * STEPS).astype(np.int64)


def grid_values() -> np.ndarray:
    """The lowest output of every place on the grid."""
    return np.arange(GRID) / STEPS - BOUND
