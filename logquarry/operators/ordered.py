"""Order-dependent steps (carry forward, shift, positions, running totals) that never need a whole key in one task.

Rows of a key are cut into chunks that follow the row order. A step works inside each chunk, and one
small row per (key, chunk) hands the state on to the next chunk. A single key, however large, is
therefore spread over as many tasks as it has chunks.

Two ways to cut:
* `by_lines`: the chunk is the line number divided by a constant, so no chunk exceeds that many lines;
* `by_range`: a range partitioning on (keys, order); the partition number is the chunk, fixed by writing
  the table, so that both uses of it (rows and hand-over rows) agree even after an executor is lost.

Every input takes this one path, whatever its size.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
CHUNK_LINES = 65536


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that `spark.checkpoint.dir` names; only a local session without it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="logquarry-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once that several later steps read: written to the shared folder and read back.

    The lineage is cut, a lost executor only re-reads files, later steps read just the columns they
    need, and the size estimate becomes that of the files.
    """
    folder = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@dataclass(frozen=True)
class Ordered:
    """A DataFrame with a chunk column, its keys and its row order (all ascending)."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    def _rows(self, back: bool = False):
        order = [F.col(c).desc() if back else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*order)

    def _chunks(self, back: bool = False):
        window = Window.partitionBy(*self.keys).orderBy(F.col(CHUNK).desc() if back else F.col(CHUNK).asc())
        return window.rowsBetween(Window.unboundedPreceding, -1)

    def _with(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def _join(self, df: DataFrame, entry: DataFrame) -> DataFrame:
        return df.join(entry, [*self.keys, CHUNK], "left")

    def select(self, *columns) -> Ordered:
        """Project without losing keys, order or chunk."""
        return self._with(self.df.select(*self.keys, *[c for c in self.order if c not in self.keys], CHUNK, *columns))

    def where(self, condition: Column) -> Ordered:
        return self._with(self.df.where(condition))

    def rows(self) -> DataFrame:
        return self.df.drop(CHUNK)

    def carry(
        self,
        last: dict[str, str] | None = None,
        above: dict[str, str] | None = None,
        next: dict[str, str] | None = None,
        below: dict[str, str] | None = None,
    ) -> Ordered:
        """Nearest non-null values, each as {new column: source column}.

        `last` looks at the row itself and the rows before it, `above` only before it,
        `next` at the row itself and the rows after it, `below` only after it.
        """
        kinds = ((last, False, 0), (above, False, -1), (next, True, 0), (below, True, -1))
        local, incoming = {}, {}
        for columns, back, end in kinds:
            frame = self._rows(back).rowsBetween(Window.unboundedPreceding, end)
            for new, old in (columns or {}).items():
                local[new] = F.last(F.col(old), ignorenulls=True).over(frame)
                incoming[new] = (old, back)
        tails = {}
        for old, back in set(incoming.values()):
            rank = F.when(F.col(old).isNotNull(), F.struct(*self.order))
            tails[old, back] = (F.min_by if back else F.max_by)(F.col(old), rank).alias(f"_{'n' if back else 'l'}_{old}")
        entry = self.df.groupBy(*self.keys, CHUNK).agg(*tails.values())
        entry = entry.select(
            *self.keys,
            CHUNK,
            *[
                F.last(f"_{'n' if back else 'l'}_{old}", ignorenulls=True).over(self._chunks(back)).alias(f"_in_{new}")
                for new, (old, back) in incoming.items()
            ],
        )
        seen = F.lit(False)
        for new in incoming:
            seen = seen | F.col(f"_in_{new}").isNotNull()
        df = self.df.select("*", *[c.alias(f"_own_{n}") for n, c in local.items()])
        df = self._join(df, entry.where(seen))
        return self._with(df.select(*self.df.columns, *[F.coalesce(f"_own_{n}", f"_in_{n}").alias(n) for n in local]))

    def shift(self, previous: dict[str, str] | None = None, next: dict[str, str] | None = None) -> Ordered:
        """Values of the previous and of the next row, null at the ends of a key."""
        sides = [(c, back) for c, back in ((previous, False), (next, True)) if c]
        ends, entry, local, out = [], [], [], []
        for columns, back in sides:
            tag, row = ("n" if back else "p"), F.struct(*[F.col(o).alias(n) for n, o in columns.items()])
            order = F.col(CHUNK).desc() if back else F.col(CHUNK).asc()
            ends.append((F.min_by if back else F.max_by)(row, F.struct(*self.order)).alias(f"_end_{tag}"))
            entry.append(F.lag(f"_end_{tag}").over(Window.partitionBy(*self.keys).orderBy(order)).alias(f"_in_{tag}"))
            local.append(F.lag(row).over(self._rows(back)).alias(f"_own_{tag}"))
            own = F.coalesce(f"_own_{tag}", f"_in_{tag}")
            out += [own.getField(n).alias(n) for n in columns]
        chunks = self.df.groupBy(*self.keys, CHUNK).agg(*ends).select(*self.keys, CHUNK, *entry)
        df = self._join(self.df.select("*", *local), chunks)
        return self._with(df.select(*self.df.columns, *out))

    def positions(self, number: str = "rn", total: str | None = None) -> Ordered:
        """1-based row number inside the key and, if named, the number of rows of the key."""
        df = self.df.withColumn(number, F.row_number().over(self._rows()).cast("long"))
        sizes = self.df.groupBy(*self.keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
        entry = sizes.select(
            *self.keys,
            CHUNK,
            F.coalesce(F.sum("_n").over(self._chunks()), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy(*self.keys)).alias("_total"),
        )
        joined = self._join(df, entry)
        kept = [c for c in df.columns if c != number]
        out = [*kept, (F.col(number) + F.col("_before")).alias(number)]
        if total:
            out.append(F.col("_total").alias(total))
        return self._with(joined.select(*out))

    def running(self, columns: dict[str, str], how: str = "sum", exclusive: bool = False) -> Ordered:
        """Running `sum` or `max` of a column in row order, as {new column: source column}."""
        fn = {"sum": F.sum, "max": F.max}[how]
        frame = self._rows().rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        tails = self.df.groupBy(*self.keys, CHUNK).agg(*[fn(o).alias(f"_in_{n}") for n, o in columns.items()])
        entry = tails.select(
            *self.keys, CHUNK, *[fn(f"_in_{n}").over(self._chunks()).alias(f"_in_{n}") for n in columns]
        )
        df = self.df.select("*", *[fn(o).over(frame).alias(f"_own_{n}") for n, o in columns.items()])
        df = self._join(df, entry)
        if how == "max":
            merged = {n: F.greatest(f"_own_{n}", f"_in_{n}") for n in columns}
        else:
            merged = {
                n: F.when(
                    F.col(f"_own_{n}").isNotNull() | F.col(f"_in_{n}").isNotNull(),
                    F.coalesce(f"_own_{n}", F.lit(0)) + F.coalesce(f"_in_{n}", F.lit(0)),
                )
                for n in columns
            }
        return self._with(df.select(*self.df.columns, *[c.alias(n) for n, c in merged.items()]))


def by_lines(
    df: DataFrame,
    keys: tuple[str, ...] = ("file_id", "entry_ord", "path"),
    order: tuple[str, ...] = ("line_no",),
    line: str = "line_no",
    lines: int | None = None,
) -> Ordered:
    """Cut on the line number; order columns in front of it are part of the chunk."""
    block, front = F.floor(F.col(line) / (lines or CHUNK_LINES)), order[: order.index(line)]
    chunk = F.struct(*front, block.alias("block")) if front else block
    return Ordered(df.withColumn(CHUNK, chunk), tuple(keys), tuple(order))


def by_range(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> Ordered:
    """Cut a global range partitioning on (keys, order) at its partition borders."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return Ordered(settle(ranged), tuple(keys), tuple(order))


def median_by_position(df: DataFrame, keys: tuple[str, ...], value: str, ties: tuple[str, ...], name: str) -> DataFrame:
    """Exact median per key: the mean of the one or two middle rows of the value order."""
    ranked = by_range(df, keys, (value, *ties)).positions("_rn", "_n").rows()
    middle = (F.col("_rn") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_rn") == F.floor(F.col("_n") / 2) + 1)
    return ranked.where(middle).groupBy(*keys).agg(F.avg(value).alias(name))
