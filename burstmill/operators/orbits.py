"""State vectors of an orbit at any time, baselines of pairs from them, and the places of ground points in an image.

A line's position is interpolated between the state vectors around it: an as-of join finds the last vector at or before its
time, which carries along the vectors beside it, and the cubic through `POINTS` of them (in Newton's form) gives position and, by
its derivative, velocity. Vectors are few for each orbit and are windowed by themselves; lines are dealt to buckets of the vectors'
largest spacing, so that the as-of join is an equi-join on (orbit, bucket) and no line meets more than the vectors of its bucket.

Lengths are metres, times seconds. Lines before the second vector or behind the last but one have no position (null), nor
has an orbit of fewer than `POINTS` vectors. Vectors that repeat a time count once, the one of the smallest position. Null
times are dropped. Extra columns of the lines are kept.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstmill.shared import materialize

#: Vectors that one polynomial goes through: two before and two behind a line's time.
POINTS = 4
AXES = ("x", "y", "z")
# WGS84 ellipsoid and the speed of light.
_A, _F, LIGHT = 6378137.0, 1 / 298.257223563, 299792458.0
_E2 = _F * (2 - _F)
#: Halvings after which an interval of a minute is below a nanosecond.
HALVINGS = 40


def spans(vectors: DataFrame, by: tuple[str, ...] = ("orbit",), time: str = "t") -> DataFrame:
    """(by, t0 to t3, x0 to x3, y0 to y3, z0 to z3, last): the POINTS vectors around each interval from t1 to t2 between vectors
    (by, t, x, y, z); last: it is their last one. Intervals that follow each other repeat three vectors, which a shuffle's
    compression finds and which their divided differences would hide; those are made by with_curve, after the shuffle."""
    once = vectors.filter(F.col(time).isNotNull()).groupBy(*by, F.col(time).cast("double").alias("_t")).agg(F.min(F.struct(*(F.col(c).cast("double").alias(c) for c in AXES))).alias("_p"))
    line = Window.partitionBy(*by).orderBy("_t")
    knots = once.select(*by, "_t", *(F.col(f"_p.{c}").alias(f"_{c}") for c in AXES))
    beside = knots.select(*by, *(F.lead(f"_{c}", k - 1).over(line).alias(f"{c}{k}") for c in ("t", *AXES) for k in range(POINTS)), F.lead("_t", POINTS - 1).over(line).isNull().alias("last"))
    return beside.filter(" AND ".join(f"t{k} IS NOT NULL" for k in range(POINTS)))


def with_curve(found: DataFrame, of: str = "") -> tuple[DataFrame, Column]:
    """found, which has the columns of spans() (under the alias `of`), with their divided differences; and the cubic as a struct:
    t0, the first vector's time; s1 and s2, those of the next two from t0 on; Newton's coefficients for each axis."""
    f = lambda k, c: F.col(f"{of}{c}{k}")
    for n in range(1, POINTS):
        over = lambda c, i, j: F.col(f"_{c}{i}{j}") if i < j else f(i, c)
        found = found.withColumns({f"_{c}{k}{k + n}": (over(c, k + 1, k + n) - over(c, k, k + n - 1)) / (f(k + n, "t") - f(k, "t")) for c in AXES for k in range(POINTS - n)})
    axes = (F.array(f(0, c), *(F.col(f"_{c}0{k}") for k in range(1, POINTS))).alias(c) for c in AXES)
    return found, F.struct(f(0, "t").alias("t0"), (f(1, "t") - f(0, "t")).alias("s1"), (f(2, "t") - f(0, "t")).alias("s2"), *axes)


def state(curve: Column, t: Column) -> tuple[Column, Column]:
    """Structs of position and velocity at t."""
    s, s1, s2 = t - curve["t0"], t - curve["t0"] - curve["s1"], t - curve["t0"] - curve["s2"]
    position = F.struct(*((curve[c][0] + s * (curve[c][1] + s1 * (curve[c][2] + s2 * curve[c][3]))).alias(c) for c in AXES))
    velocity = F.struct(*((curve[c][1] + (s + s1) * curve[c][2] + (s * s1 + s * s2 + s1 * s2) * curve[c][3]).alias(c) for c in AXES))
    return position, velocity


def with_state(lines: DataFrame, vectors: DataFrame, time: str, by: tuple[str, ...] = ("orbit",)) -> DataFrame:
    """lines and the structs position and velocity at their time, null outside the vectors' reach."""
    found = materialize(spans(vectors, by), "spans")
    wide = found.agg(F.max(F.col("t2") - F.col("t1"))).first()[0] or 1.0
    bucket = lambda c: F.floor(c / F.lit(wide)).cast("long")
    # an interval is no wider than a bucket, so it lies in one or two of them
    dealt = found.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("t1")), bucket(F.col("t2")))))
    a, b = lines.withColumn("_t", F.col(time).cast("double")).alias("a"), dealt.alias("b")
    within = (F.col("a._t") >= F.col("b.t1")) & ((F.col("a._t") < F.col("b.t2")) | (F.col("b.last") & (F.col("a._t") == F.col("b.t2"))))
    on = reduce(lambda p, q: p & q, [*(F.col(f"a.{c}") == F.col(f"b.{c}") for c in by), bucket(F.col("a._t")) == F.col("b._bucket")]) & within
    met, curve = with_curve(a.join(b, on, "left"), "b.")
    position, velocity = state(curve, F.col("a._t"))
    there = F.col("b.t1").isNotNull()
    return met.select(*(F.col(f"a.{c}") for c in lines.columns), F.when(there, position).alias("position"), F.when(there, velocity).alias("velocity"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def minus(a: Column, b: Column) -> Column:
    return F.struct(*((a[c] - b[c]).alias(c) for c in AXES))


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def geocentric(lon: Column, lat: Column, height: Column) -> Column:
    """The struct (x, y, z) of a place on or above the ellipsoid; degrees and metres."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = _A / F.sqrt(1 - _E2 * F.sin(phi) * F.sin(phi))
    return F.struct(((n + height) * F.cos(phi) * F.cos(lam)).alias("x"), ((n + height) * F.cos(phi) * F.sin(lam)).alias("y"), ((n * (1 - _E2) + height) * F.sin(phi)).alias("z"))


def baseline(position: Column, velocity: Column, other: Column, target: Column) -> tuple[Column, Column]:
    """(parallel, perpendicular) parts of the baseline to another position, seen along the line of sight to a target.

    What lies along the track is taken off first. The perpendicular part is positive where the other position lies farther up.
    """
    track = F.transform(F.array(*(velocity[c] for c in AXES)), lambda v: v / length(velocity))
    unit = F.struct(*(track[k].alias(c) for k, c in enumerate(AXES)))
    b, look = minus(other, position), minus(target, position)
    flat = lambda v: F.struct(*((v[c] - dot(v, unit) * unit[c]).alias(c) for c in AXES))
    b, look = flat(b), flat(look)
    parallel = dot(b, look) / length(look)
    across = F.sqrt(F.greatest(dot(b, b) - parallel * parallel, F.lit(0.0)))
    rest = F.struct(*((b[c] - parallel * look[c] / length(look)).alias(c) for c in AXES))
    return parallel, F.when(dot(rest, position) < 0, -across).otherwise(across)


def baselines(images: DataFrame, vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(prm, sec, parallel, perpendicular) for pairs (prm, sec) of images (image, orbit, t, target): t is the time of closest
    approach to the scene's centre, target that centre as a struct (x, y, z)."""
    placed = with_state(images, vectors, "t").select("image", "position", "velocity", "target")
    prm = placed.select(F.col("image").alias("prm"), "position", "velocity", "target")
    sec = placed.select(F.col("image").alias("sec"), F.col("position").alias("_other"))
    along, across = baseline(F.col("position"), F.col("velocity"), F.col("_other"), F.col("target"))
    return pairs.join(prm, "prm").join(sec, "sec").select("prm", "sec", along.alias("parallel"), across.alias("perpendicular"))


def radar_places(points: DataFrame, vectors: DataFrame, image: dict[str, float], place: str = "place", by: tuple[str, ...] = ("orbit",)) -> DataFrame:
    """points (by, place, ...) with t, line and sample: where a sensor that looks sideways sees each of them.

    A point is seen at zero Doppler, when it lies at right angles to the track: dot(place - position, velocity) falls through 0.
    Each interval of vectors whose ends have different signs holds such a time; HALVINGS bisections of column expressions
    find it. image: start and interval of lines, near (range time of sample 0) and spacing (of samples, in seconds).
    Points that no interval holds are dropped; one that several orbits' intervals hold comes once for each.
    """
    found, curve = with_curve(spans(vectors, by))
    found = found.select(*by, F.col("t1").alias("begin"), F.col("t2").alias("until"), curve.alias("curve"))
    lag = lambda t: (lambda p, v: dot(minus(F.col(place), p), v))(*state(F.col("curve"), t))
    met = points.join(found, list(by)).withColumns({"_lo": F.col("begin"), "_hi": F.col("until")})
    met = met.filter((lag(F.col("begin")) >= 0) & (lag(F.col("until")) < 0))

    def halved(acc: Column, _: Column) -> Column:
        middle = (acc["lo"] + acc["hi"]) / 2
        return F.when(lag(middle) >= 0, F.struct(middle.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), middle.alias("hi")))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.col("begin").alias("lo"), F.col("until").alias("hi")), halved)
    met = met.withColumn("_e", ends).withColumn("t", (F.col("_e.lo") + F.col("_e.hi")) / 2)
    position, _ = state(F.col("curve"), F.col("t"))
    slant = length(minus(F.col(place), position))
    line = (F.col("t") - F.lit(image["start"])) / F.lit(image["interval"])
    sample = (2 * slant / LIGHT - F.lit(image["near"])) / F.lit(image["spacing"])
    return met.select(*points.columns, "t", line.alias("line"), sample.alias("sample"))


def circular(radius: float, period: float, inclination: float) -> tuple[str, str, str]:
    """Expressions of t for a circular orbit, for tests and models: no earth rotation."""
    w = 2 * math.pi / period
    c, s = math.cos(inclination), math.sin(inclination)
    return f"{radius!r} * cos({w!r} * t)", f"{radius * c!r} * sin({w!r} * t)", f"{radius * s!r} * sin({w!r} * t)"
