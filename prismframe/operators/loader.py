"""Epoch queries: subset, shuffle, shard, batch, project, transform - one declarative plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from prismframe.functions.rng import uniform
from prismframe.operators import ordinal

Step = Callable[[DataFrame], DataFrame]


class Loader:
    """Rows of a table with an `_idx` column, as batches of an epoch.

    rows: how many rows the subset has (counted if not given).  indices: a table
    (_at, _idx) of row ids, in order and with repeats, or None for all rows.  Every
    draw is a function of (seed, epoch, row), so an epoch can be asked for again, by
    any worker, in any order.
    """

    def __init__(self, table: DataFrame, batch_size: int = 256, shuffle: bool = True, seed: int = 0, indices: DataFrame | None = None, world: int = 1, rank: int = 0, drop_last: bool = True, exclude: tuple[str, ...] = (), pipelines: dict[str, list[Step]] | None = None, after_batch: list[Step] | None = None, rows: int | None = None):
        self.table, self.batch_size, self.shuffle, self.seed, self.indices = table, batch_size, shuffle, seed, indices
        self.world, self.rank, self.drop_last, self.exclude = world, rank, drop_last, exclude
        self.pipelines, self.after_batch, self._rows, self.epoch = pipelines or {}, after_batch or [], rows, 0

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = (self.table if self.indices is None else self.indices).count()
        return self._rows

    @property
    def shard_rows(self) -> int:
        return -(-self.rows // self.world)

    def __len__(self) -> int:
        return self.shard_rows // self.batch_size if self.drop_last else -(-self.shard_rows // self.batch_size)

    def set_epoch(self, epoch: int) -> Loader:
        self.epoch = epoch
        return self

    def order(self) -> DataFrame:
        """(_idx, _pos) of this rank: the padded, strided shard of the epoch's order."""
        ids = self.table.select(F.col("_idx"), F.col("_idx").alias("_at")) if self.indices is None else self.indices.select("_idx", "_at")
        if self.shuffle:
            placed = ordinal.shuffled(ids, uniform(f"epoch{self.seed + self.epoch}", "_at"), "_at")
        else:
            placed = ordinal.in_order(ids, "_at")
        if self.world > 1:
            short = self.shard_rows * self.world - self.rows
            if short > self.rows:
                raise ValueError("fewer rows than shards need to be even")
            head = placed.where(F.col("_pos") < short).withColumn("_pos", F.col("_pos") + self.rows)
            placed = placed.unionByName(head).where(F.pmod("_pos", F.lit(self.world)) == self.rank).withColumn("_pos", F.floor(F.col("_pos") / self.world).cast("long"))
        return placed.select("_idx", "_pos")

    def plan(self) -> DataFrame:
        size = self.batch_size
        order = self.order().withColumn("_batch", F.floor(F.col("_pos") / size).cast("long")).withColumn("_slot", F.pmod("_pos", F.lit(size)).cast("long"))
        if self.drop_last:
            order = order.where(F.col("_batch") < len(self))
        out = order.join(self.table.drop(*self.exclude), "_idx")
        for steps in self.pipelines.values():
            out = reduce(lambda d, f: f(d), steps, out)
        return reduce(lambda d, f: f(d), self.after_batch, out)

    def batches(self, columns: list[str] | None = None) -> DataFrame:
        """A row for each batch: its rows in slot order, as a list of structs (bounded by the batch size)."""
        out = self.plan()
        names = columns or [c for c in out.columns if c not in ("_pos", "_batch", "_slot")]
        return out.groupBy("_batch").agg(F.array_sort(F.collect_list(F.struct("_slot", *names))).alias("rows"))

    def __iter__(self) -> Iterator[Row]:
        """Batches one after the other, the next partitions fetched ahead."""
        return self.batches().orderBy("_batch").toLocalIterator(prefetchPartitions=True)

    def warmup(self) -> dict[str, int]:
        """Keeps the table in the executors' memory and disks, whole; how many rows and partitions it has. The epoch stays as it is."""
        kept = self.table.persist()
        return {"rows": kept.count(), "partitions": kept.rdd.getNumPartitions()}

    def shutdown(self) -> None:
        self.table.unpersist()
