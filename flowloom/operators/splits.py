"""Cutting hot keys into time-ordered pieces.

Ordered operators (gap sessionizing, running sums, lags, leads, as-of) are
windows over a key.  A key that owns a large share of the rows would put that
share into one task.  ``find_splits`` looks at a sample, names the keys that
are too large, and picks cut points along time for each of them.
``Splits.attach`` then adds a ``CHUNK`` column: 0 for ordinary keys, an
increasing number along time for hot ones.  Operators window over
``(key, CHUNK)`` and carry the little state that crosses a cut.

The cuts are plain numbers frozen on the driver, so every branch of a plan and
every retried task sees the same chunks.  They only decide balance: any cuts
give the same results.  There are about ``rows / rows_per_task`` of them, or
``MAX_CUTS`` if that is less and pieces of ``config.ROWS_PER_TASK`` rows allow
it, which bounds the lists on the driver and the tables that are broadcast here.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowloom.config import ROWS_PER_TASK

CHUNK = "_chunk"
HALO = "_halo"

SAMPLES_PER_TASK = 64
SUB_CHUNKS = 1 << 20
# Cuts of one table, if pieces smaller than the default would give more.
MAX_CUTS = 4096
# Positions within a key run from 0 up to this.
TOP = 1.0 - 1e-6


@dataclass
class Splits:
    """Frozen cut points.  ``keys`` empty means one global time line."""

    keys: tuple[str, ...]
    ts: str
    tie: str | None = None
    cuts: list[float] = field(default_factory=list)
    # one row per hot key: key values, index, first and last timestamp, last chunk
    hot_rows: list[tuple] = field(default_factory=list)
    hot_schema: StructType | None = None
    # (bucket, timestamp, copies): timestamps that alone exceed a task
    heavy: list[tuple[int, int, int]] = field(default_factory=list)
    tie_cuts: list[float] = field(default_factory=list)

    def on(self, ts: str, tie: str | None = None) -> "Splits":
        """The same cuts for a table that names its time column differently."""
        return replace(self, ts=ts, tie=tie)

    def renamed(self, *keys: str) -> "Splits":
        """The same cuts for a table that names the keys differently."""
        if self.hot_schema is None:
            return replace(self, keys=keys)
        fields = [StructField(n, f.dataType) for n, f in zip(keys, self.hot_schema)]
        return replace(self, keys=keys, hot_schema=StructType(fields + self.hot_schema.fields[len(keys) :]))

    @property
    def trivial(self) -> bool:
        return not self.cuts

    @property
    def last_chunk(self) -> int:
        return len(self.cuts) + 1

    @property
    def last_id(self) -> int:
        """No chunk has a larger number."""
        return (self.last_chunk + 1) * (SUB_CHUNKS if self.heavy and self.tie else 1)

    def hot_keys(self, df: DataFrame) -> DataFrame:
        """The hot keys with ``_k, _lo, _hi, _last``; at most one row per cut."""
        return df.sparkSession.createDataFrame(self.hot_rows, self.hot_schema)

    def attach(self, df: DataFrame, subdivide: bool = True) -> DataFrame:
        """Add ``CHUNK``; it never decreases along (ts, tie) within a key."""
        if self.trivial:
            return df.withColumn(CHUNK, F.lit(0).cast("long"))
        own = df.columns
        if self.keys:
            df = df.join(F.broadcast(self.hot_keys(df)), list(self.keys), "left")
            lo, hi, base = F.col("_lo"), F.col("_hi"), F.col("_k").cast("double")
        else:
            lo, hi = (F.lit(v).cast("long") for v in self.hot_rows[0][1:3])
            base = F.lit(0.0)
        share = (F.col(self.ts) - lo).cast("double") / (hi - lo + 1).cast("double")
        df = df.withColumn("_x", base + F.greatest(F.lit(0.0), F.least(F.lit(TOP), share)))
        df = df.withColumn("_x", F.when(F.col(self.ts).isNotNull(), F.col("_x")))
        df = Bucketizer(
            splits=[float("-inf"), *self.cuts, float("inf")],
            inputCol="_x",
            outputCol="_b",
            handleInvalid="keep",
        ).transform(df)
        bucket = F.col("_b").cast("long")
        if subdivide and self.heavy and self.tie:
            df = self._subdivide(df.withColumn("_b", bucket))
            chunk = (F.col("_b") + 1) * SUB_CHUNKS + F.coalesce(F.col("_sub"), F.lit(0))
        else:
            chunk = bucket + 1
        return df.select(*own, F.when(F.col("_x").isNull(), F.lit(0)).otherwise(chunk).cast("long").alias(CHUNK))

    def _subdivide(self, df: DataFrame) -> DataFrame:
        """Cut the rows of one overfull timestamp along the tie column."""
        table = df.sparkSession.createDataFrame(
            [(b, t) for b, t, _ in self.heavy], "_b long, _heavy_ts long"
        )
        df = df.join(F.broadcast(table), "_b", "left")
        df = df.withColumn("_t", F.col(self.tie).cast("double"))
        df = Bucketizer(
            splits=[float("-inf"), *self.tie_cuts, float("inf")],
            inputCol="_t",
            outputCol="_tb",
            handleInvalid="keep",
        ).transform(df)
        here = F.col("_heavy_ts")
        return df.withColumn(
            "_sub",
            F.when(here.isNull() | (F.col(self.ts) < here), F.lit(0))
            .when(F.col(self.ts) == here, F.col("_tb").cast("long") + 1)
            .otherwise(F.lit(SUB_CHUNKS - 1)),
        )


def _share(ts: int, lo: int, hi: int) -> float:
    return max(0.0, min(TOP, float(ts - lo) / float(hi - lo + 1)))


def find_splits(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    seed: int = 17,
) -> Splits:
    """Sample ``df`` and choose cuts for keys above twice ``rows_per_task``.

    ``ts`` and ``tie`` must be integral.  The rows of the sample alone decide: how
    many bytes the source has on disk says little about how many rows it yields.
    Pieces of so few rows that there would be more than ``MAX_CUTS`` are made larger.
    """
    keys = tuple(keys)
    result = Splits(keys, ts, tie)
    columns = [*keys, ts] + ([tie] if tie else [])
    sample = df.select(*columns).where(F.col(ts).isNotNull())
    if rows_per_task < ROWS_PER_TASK:
        rows_per_task = _piece_rows(sample.count(), rows_per_task)
    fraction = min(1.0, SAMPLES_PER_TASK / rows_per_task)
    step = max(1, round(rows_per_task * fraction))
    if fraction < 1.0:
        sample = sample.sample(fraction=fraction, seed=seed)
    return _keyed_cuts(sample, result, step) if keys else _global_cuts(sample, result, step)


def _piece_rows(rows: int, rows_per_task: int) -> int:
    """Rows of a piece: as asked, or what keeps ``rows`` within ``MAX_CUTS``, but not above the default for that."""
    return max(rows_per_task, min(ROWS_PER_TASK, -(-rows // MAX_CUTS)))


def _keyed_cuts(sample: DataFrame, result: Splits, step: int) -> Splits:
    keys, ts, tie = result.keys, result.ts, result.tie
    by_key = Window.partitionBy(*keys)
    ordered = by_key.orderBy(*([ts, tie] if tie else [ts]))
    picked = (
        sample.where(~_any_null(keys))
        .withColumn("_n", F.count(F.lit(1)).over(by_key))
        .where(F.col("_n") >= 2 * step)
        .withColumn("_r", F.row_number().over(ordered))
        .where(((F.col("_r") - 1) % step == 0) | (F.col("_r") == F.col("_n")))
        .select(*keys, ts, *([tie] if tie else []), "_r")
    )
    fields = [picked.schema[k] for k in keys]
    groups: dict[tuple, list[tuple[int, int | None, int]]] = {}
    width = len(keys)
    for row in picked.collect():
        groups.setdefault(tuple(row[:width]), []).append(
            (row[width], row[width + 1] if tie else None, row["_r"])
        )
    cuts: set[float] = set()
    seen: dict[tuple[int, int], list[int]] = {}
    spans = []
    for index, (key, points) in enumerate(groups.items()):
        points.sort(key=lambda p: p[2])
        lo, hi = points[0][0], points[-1][0]
        spans.append((key, index, lo, hi))
        if index:
            cuts.add(float(index))
        for t, tie_value, _ in points[1:-1]:
            cuts.add(index + _share(t, lo, hi))
            seen.setdefault((index, t), []).append(tie_value)
    tie_cuts: set[float] = set()
    heavy_points = []
    for (index, t), ties in seen.items():
        if len(ties) >= 2:
            heavy_points.append((index, t, len(ties)))
            tie_cuts.update(float(v) for v in ties if v is not None)
            _, _, lo, hi = spans[index]
            cuts.add(index + _share(t + 1, lo, hi))
    # a cut at the very bottom of a key separates nothing
    result.cuts = sorted(c for c in cuts if c > 0.0)
    if not result.cuts:
        return result
    result.tie_cuts = _checked(sorted(tie_cuts))
    taken: dict[int, tuple[int, int, int]] = {}
    for index, t, copies in heavy_points:
        _, _, lo, hi = spans[index]
        bucket = bisect_right(result.cuts, index + _share(t, lo, hi))
        if bucket not in taken or taken[bucket][2] < copies:
            taken[bucket] = (bucket, t, copies)
    result.heavy = sorted(taken.values())
    result.hot_rows = [
        (*key, index, lo, hi, bisect_right(result.cuts, index + TOP) + 1) for key, index, lo, hi in spans
    ]
    result.hot_schema = StructType(
        fields + [StructField(n, LongType()) for n in ("_k", "_lo", "_hi", "_last")]
    )
    return result


def _checked(tie_cuts: list[float]) -> list[float]:
    """Sub-chunks are numbered within ``SUB_CHUNKS``; more would break their order."""
    if len(tie_cuts) + 2 >= SUB_CHUNKS:
        raise ValueError(f"{len(tie_cuts)} cuts along ties; raise rows_per_task")
    return tie_cuts


def _accuracy(pieces: int) -> int:
    """Quantile accuracy well below one piece, within what a summary may hold."""
    return max(10_000, min(20 * pieces, 1_000_000))


def _global_cuts(sample: DataFrame, result: Splits, step: int) -> Splits:
    ts = result.ts
    n, lo, hi = sample.agg(F.count(ts), F.min(ts), F.max(ts)).first()
    pieces = n // step
    if pieces < 2:
        return result
    points = [i / pieces for i in range(1, pieces)]
    found = sample.agg(
        F.percentile_approx(ts, points, _accuracy(pieces)).alias("p")
    ).first()["p"]
    copies: dict[int, int] = {}
    for t in found:
        copies[t] = copies.get(t, 0) + 1
    cuts = {_share(t, lo, hi) for t in found}
    cuts.update(_share(t + 1, lo, hi) for t, c in copies.items() if c >= 2)
    result.cuts = sorted(c for c in cuts if c > 0.0)
    result.hot_rows = [(0, lo, hi, len(result.cuts) + 1)]
    taken: dict[int, tuple[int, int, int]] = {}
    for t, c in copies.items():
        if c >= 2:
            bucket = bisect_right(result.cuts, _share(t, lo, hi))
            if bucket not in taken or taken[bucket][2] < c:
                taken[bucket] = (bucket, t, c)
    result.heavy = sorted(taken.values())
    if result.heavy and result.tie:
        # tie cuts for the overfull timestamps, in proportion to their rows
        wanted = sample.sparkSession.createDataFrame([(t,) for _, t, _ in result.heavy], f"{ts} long")
        ways = sum(c for _, _, c in result.heavy) + 1
        ties = (
            sample.join(F.broadcast(wanted), ts, "left_semi")
            .agg(F.percentile_approx(result.tie, [i / ways for i in range(1, ways)], _accuracy(ways)))
            .first()[0]
        )
        result.tie_cuts = _checked(sorted({float(v) for v in ties}))
    return result


def _any_null(names: Sequence[str]) -> Column:
    test = F.lit(False)
    for name in names:
        test = test | F.col(name).isNull()
    return test


def spread(df: DataFrame, splits: Splits, name: str = "_salt", by: Sequence[str] = ()) -> DataFrame:
    """Salt the rows of a global chunk that one timestamp overfills.

    Only for rows that do not depend on each other, such as as-of probes.
    """
    if splits.trivial or not splits.heavy:
        return df.withColumn(name, F.lit(0).cast("long"))
    ways = _ways(df, splits)
    return (
        df.join(F.broadcast(ways), CHUNK, "left")
        .withColumn(name, F.pmod(F.xxhash64(*by), F.coalesce(F.col("_ways"), F.lit(1))).cast("long"))
        .drop("_ways")
    )


def copy_to_salts(df: DataFrame, splits: Splits, name: str = "_salt") -> DataFrame:
    """Give every salt of an overfull chunk its own copy of ``df``'s rows."""
    if splits.trivial or not splits.heavy:
        return df.withColumn(name, F.lit(0).cast("long"))
    ways = _ways(df, splits)
    return (
        df.join(F.broadcast(ways), CHUNK, "left")
        .withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_ways"), F.lit(1)) - 1)))
        .drop("_ways")
    )


def _ways(df: DataFrame, splits: Splits) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(bucket + 1, copies + 1) for bucket, _, copies in splits.heavy], f"{CHUNK} long, _ways long"
    )


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Copy the rows just outside each hot chunk into it, marked by ``HALO``.

    Every chunk of a hot key receives the last ``before`` rows of the key ahead
    of it and the first ``after`` rows behind it, so that offset windows over
    (key, chunk) see the same neighbours as windows over the whole key.
    """
    if (before > 0) == (after > 0):
        raise ValueError("give either before or after")
    own = df.columns
    reach = before or after
    ranked = [F.col(c).desc() if before else F.col(c).asc() for c in order]
    edge = (
        df.where(F.col(CHUNK) > 0)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*ranked)))
        .where(F.col("_rank") <= reach)
    )
    line = Window.partitionBy(*keys).orderBy(CHUNK, *order)
    frame = line.rowsBetween(-reach, -1) if before else line.rowsBetween(1, reach)
    beside = F.lag(CHUNK).over(line) if before else F.lead(CHUNK).over(line)
    copies = (
        edge.withColumn("_near", F.collect_list(F.struct(*own)).over(frame))
        .withColumn("_beside", beside)
        .where(F.col("_beside") != F.col(CHUNK))
        .select(F.col(CHUNK).alias("_into"), F.explode("_near").alias("_row"))
        .select(
            *[F.col("_into").alias(c) if c == CHUNK else F.col(f"_row.{c}").alias(c) for c in own],
            F.lit(True).alias(HALO),
        )
    )
    return df.withColumn(HALO, F.lit(False)).unionByName(copies)
