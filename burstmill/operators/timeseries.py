"""What follows the inversion of a network: which pairs to use, how well it fits, ramps, velocities, steps and height errors.

Fits go by normal equations: sums of products are aggregated (partly before any shuffle), and the small systems are solved in
batches. A fit whose regressors don't tell themselves apart, or with fewer rows than regressors, is null. Rows with a null or
NaN value or regressor take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from burstmill.functions.phasors import no_nan
from burstmill.shared import ship_package

#: Ratio of a system's least to its greatest eigenvalue (after scaling) below which it is taken for singular.
SINGULAR = 1e-11


def chosen_pairs(pairs: DataFrame, coherence: str, least: float, by: tuple[str, ...] = ("burst_id",), prm: str = "prm_date", sec: str = "sec_date") -> DataFrame:
    """pairs and in_tree, kept: whether a pair is in its network's tree of greatest coherence, and whether it is that or of
    coherence `least` or more. So a network stays connected however incoherent it is.

    A network is a group of one row for each pair; it has at most as many as its dates make. Ties go to the earlier pair; a
    missing coherence is the worst; a pair that repeats is in the tree once at most.
    """
    ship_package(pairs.sparkSession)
    schema = StructType([*pairs.schema.fields, *StructType.fromDDL("in_tree boolean, kept boolean").fields])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        from burstmill.operators.unwrapping import spanning_cycles

        rows = rows.sort_by([(prm, "ascending"), (sec, "ascending")])
        ends = [rows[c].cast(pa.string()).to_pylist() for c in (prm, sec)]
        number = {d: k for k, d in enumerate(sorted({d for e in ends for d in e if d is not None}))}
        a, b = (np.array([number.get(d, 0) for d in e], np.int64) for e in ends)
        c = np.array([-1.0 if v is None or v != v else v for v in rows[coherence].cast(pa.float64()).to_pylist()])
        order = np.argsort(-c, kind="stable")
        _, _, taken = spanning_cycles(len(number), a[order], b[order], np.zeros(len(a), np.int64))
        tree = np.zeros(len(a), bool)
        tree[order[taken]] = True
        return rows.append_column("in_tree", pa.array(tree)).append_column("kept", pa.array(tree | (c >= least)))

    return pairs.groupBy(*by).applyInArrow(run, schema)


def temporal_coherence(pairs: DataFrame, series: DataFrame, by: tuple[str, ...], phase: str = "phase", displacement: str = "displacement") -> DataFrame:
    """(by, pairs, temporal_coherence): how well the dates' displacements (by, date, displacement) explain the phases of the
    pairs (by, prm_date, sec_date, phase): the length of the mean phasor of what is left, 1 at best."""
    first = series.select(*by, F.col("date").alias("prm_date"), F.col(displacement).alias("_a"))
    second = series.select(*by, F.col("date").alias("sec_date"), F.col(displacement).alias("_b"))
    left = pairs.join(first, [*by, "prm_date"]).join(second, [*by, "sec_date"]).withColumn("_r", no_nan(F.col(phase) - F.col("_b") + F.col("_a")))
    c, s = F.avg(F.cos("_r")), F.avg(F.sin("_r"))
    return left.groupBy(*by).agg(F.count("_r").alias("pairs"), F.sqrt(c * c + s * s).alias("temporal_coherence"))


def fitted(rows: DataFrame, value: str, regressors: dict[str, Column], by: tuple[str, ...]) -> DataFrame:
    """(by, n, each regressor's coefficient, rms of the residuals) by least squares, one fit for each `by`."""
    ship_package(rows.sparkSession)
    names, p = list(regressors), len(regressors)
    used = rows.select(*by, no_nan(F.col(value).cast("double")).alias("_v"), *(no_nan(c.cast("double")).alias(f"_{k}") for k, c in enumerate(regressors.values())))
    used = used.filter(" AND ".join(f"{c} IS NOT NULL" for c in ["_v", *(f"_{k}" for k in range(p))]))
    products = [F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i in range(p) for j in range(p)] + [F.sum(F.col(f"_{i}") * F.col("_v")) for i in range(p)] + [F.sum(F.col("_v") * F.col("_v"))]
    sums = used.groupBy(*by).agg(F.count("*").alias("n"), F.array(*products).alias("_s"))
    schema = StructType([*sums.select(*by, "n").schema.fields, *StructType.fromDDL(", ".join(f"`{c}` double" for c in (*names, "rms"))).fields])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            m, y, total = s[:, : p * p].reshape(-1, p, p), s[:, p * p : p * p + p], s[:, -1]
            n = b.column(b.num_columns - 2).to_numpy()
            size = np.sqrt(np.einsum("nii->ni", m))
            size[size == 0] = 1
            scaled = m / size[:, :, None] / size[:, None, :]
            values = np.linalg.eigvalsh(scaled)
            fine = (n >= p) & (values[:, 0] > SINGULAR * values[:, -1])
            scaled[~fine] = np.eye(p)
            found = np.linalg.solve(scaled, (y / size)[:, :, None])[:, :, 0] / size
            rest = np.sqrt(np.maximum(total - (found * y).sum(1), 0) / np.maximum(n, 1))
            columns = [pa.array(c, mask=~fine) for c in (*found.T, rest)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=schema.names)

    return sums.mapInArrow(solve, schema)


def velocity(series: DataFrame, value: str, by: tuple[str, ...], t: str = "date", steps: list[str] = (), baseline: str | None = None) -> DataFrame:
    """(by, n, offset, velocity a year, step_1.., height, rms): a line, jumps at the given dates and, with a column of
    perpendicular baselines, the part that goes with them (the height error's), all fitted together."""
    day = F.datediff(F.col(t), F.lit("2000-01-01"))
    terms = {"offset": F.lit(1.0), "velocity": day / 365.25}
    terms |= {f"step_{k}": (F.col(t) >= F.lit(s).cast("date")).cast("double") for k, s in enumerate(steps, 1)}
    terms |= {"height": F.col(baseline)} if baseline else {}
    return fitted(series, value, terms, by)


def deramped(series: DataFrame, value: str, by: tuple[str, ...] = ("date",), mask: Column | None = None, rounds: int = 2, beyond: float = 2.5) -> DataFrame:
    """series (by, y, x, value) without each image's ramp, a plane of y and x.

    The plane is fitted to the samples of the mask. After each round those whose residual exceeds `beyond` times the rms are
    left out of the next, so that a deforming area does not tilt it. Images without a plane stay as they are.
    """
    terms = {"_r0": F.lit(1.0), "_ry": F.col("y"), "_rx": F.col("x")}
    used, plane = series if mask is None else series.filter(mask), None
    ramp = F.col("_r0") + F.col("_ry") * F.col("y") + F.col("_rx") * F.col("x")
    for _ in range(rounds):
        kept = used if plane is None else used.join(plane, list(by)).filter(F.abs(F.col(value) - ramp) <= beyond * F.col("rms") + 1e-12).select(used.columns)
        plane = fitted(kept, value, terms, by).select(*by, *terms, "rms")
    out = series.join(plane, list(by), "left")
    return out.select(*(F.col(c) if c != value else (F.col(value) - F.coalesce(ramp, F.lit(0.0))).alias(value) for c in series.columns))
