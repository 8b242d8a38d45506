"""The three products, each over all bursts, polarizations and pairs of a job at once, and their older names. Samples that
are read several times are written to the shared folder first, so building a plan runs jobs.

Burst, sub-swath and polarization are keys of every join and window, so the images of one never meet those of another.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstmill.functions.phasors import amplitude, phase
from burstmill.operators import bursts, cube, kernels, pairs, resampling, unwrapping
from burstmill.shared import materialize, maybe_broadcast
from burstmill.sources.parameters import Job

BURST = ("burst_id", "swath", "pol")
PAIR = ("prm_date", "sec_date")
KEY = BURST + PAIR


def select_bursts(catalogue: DataFrame, job: Job, every_burst: bool = False) -> DataFrame:
    """The acquisitions of the job's polarizations: those of the burst that it names or that its box finds first, or with
    every_burst those of all bursts that it finds."""
    start, end = job.temporal_extent or (None, None)
    found = bursts.matching(catalogue, start, end, burst_id=job.burst_id, swath=job.sub_swath)
    found = found.filter(F.col("pol").isin([p.upper() for p in job.polarization]))
    if job.spatial_extent:
        from burstmill.functions.geometry import box_of, box_ring, boxes_meet, rings_meet

        e = [job.spatial_extent[k] for k in ("west", "south", "east", "north")]
        found = found.filter(F.exists("footprint", lambda ring: boxes_meet(box_of(ring), *e) & rings_meet(ring, box_ring(*e))))
    if every_burst:
        return found
    found = bursts.lowest_burst(found)
    if job.sub_swath is None:
        first = bursts.first_swath(found)
        found = found.join(F.broadcast(first), F.col("swath") == F.col("first_swath")).drop("first_swath")
    return found


def job_pairs(catalogue: DataFrame, job: Job, every_burst: bool = False) -> DataFrame:
    """(burst_id, swath, pol, prm_date, sec_date): the job's own pairs for each burst and polarization that it finds, or
    those one temporal baseline apart."""
    found = select_bursts(catalogue, job, every_burst)
    if job.InSAR_pairs:
        from burstmill.functions.dates import parse_date

        day = lambda p: F.to_date(parse_date(F.lit(p)))
        own = F.array(*(F.struct(day(a).alias("prm_date"), day(b).alias("sec_date")) for a, b in job.InSAR_pairs))
        return found.select(*BURST).distinct().withColumn("p", F.explode(own)).select(*BURST, "p.*")
    return pairs.require_pairs(pairs.offset_pairs(found, job.temporal_baseline, "start", BURST), job.temporal_extent[1])


def pair_document(found: DataFrame, swath: str, document: dict | None = None) -> DataFrame:
    """The pairs as the JSON text of a job document: the document that they were found for, as it was given, and the keys
    InSAR_pairs and sub_swath_id."""
    row = F.sort_array(F.collect_set(F.array(F.col("prm_date").cast("string"), F.col("sec_date").cast("string"))))
    own = json.dumps({k: v for k, v in (document or {}).items() if k not in ("InSAR_pairs", "sub_swath_id")}, ensure_ascii=False)
    head = F.lit("{" if own == "{}" else own[:-1] + ", ")
    added = F.to_json(F.struct(row.alias("InSAR_pairs"), F.lit(swath).alias("sub_swath_id")))
    return found.agg(F.concat(head, F.substr(added, F.lit(2))).alias("value"))


def job_samples(slc: DataFrame, job: Job) -> DataFrame:
    """The samples of the job's burst, sub-swath and polarizations, as far as it names them: folders of the table."""
    if job.burst_id is not None:
        slc = slc.filter(F.col("burst_id") == job.burst_id)
    if job.sub_swath is not None:
        slc = slc.filter(F.col("swath") == job.sub_swath.upper())
    return slc.filter(F.col("pol").isin([p.upper() for p in job.polarization]))


def paired_samples(slc: DataFrame, found: DataFrame, offsets: DataFrame | None = None, kernel: str = "sinc", carrier: str | None = None) -> DataFrame:
    """(burst_id, swath, pol, prm_date, sec_date, y, x, i1, q1, i2, q2): co-registered samples of each pair.

    Without offsets slc must lie on a common grid for each burst. With offsets (burst_id, swath, pol, prm_date, sec_date, y, x,
    dy, dx) the secondary's sample is the one at (y + dy, x + dx) of its own grid, resampled by the kernel; carrier: an
    expression of y and x for the phase to take off meanwhile.
    """
    a = slc.select(*BURST, F.col("date").alias("prm_date"), "y", "x", F.col("i").alias("i1"), F.col("q").alias("q1"))
    b = slc.select(*BURST, F.col("date").alias("sec_date"), "y", "x", F.col("i").alias("i2"), F.col("q").alias("q2"))
    few = maybe_broadcast(found.distinct())
    if offsets is None:
        return a.join(few, [*BURST, "prm_date"]).join(b, [*BURST, "sec_date", "y", "x"])
    places = offsets.join(few, list(KEY), "left_semi").select(*KEY, "y", "x", (F.col("y") + F.col("dy")).alias("at_y"), (F.col("x") + F.col("dx")).alias("at_x"))
    moved = resampling.resampled_complex(b.withColumnsRenamed({"i2": "i", "q2": "q"}), places, kernel, (*BURST, "sec_date"), carrier)
    moved = moved.filter("i IS NOT NULL AND q IS NOT NULL").select(*KEY, "y", "x", F.col("i").alias("i2"), F.col("q").alias("q2"))
    return a.join(moved, [*BURST, "prm_date", "y", "x"])


def sar_coherence(catalogue: DataFrame, slc: DataFrame, job: Job, every_burst: bool = False, offsets: DataFrame | None = None) -> DataFrame:
    """(burst_id, swath, pol, prm_date, sec_date, y, x, coh); offsets: see paired_samples. Among pairs that the job gives itself each primary may occur once."""
    found = job_pairs(catalogue, job, every_burst)
    if job.InSAR_pairs and not pairs.repeated_primaries(found, BURST).isEmpty():
        raise ValueError("a primary date is given twice")
    samples = materialize(paired_samples(job_samples(slc, job), found, offsets), "samples")
    parts = cube.densified(samples, ["i1", "q1", "i2", "q2"], KEY)
    return cube.coherence(parts, job.coherence_window_rg, job.coherence_window_az, KEY)


def sar_interferogram(
    catalogue: DataFrame,
    slc: DataFrame,
    job: Job,
    unwrap: bool = True,
    every_burst: bool = False,
    filtered: bool = False,
    reference_phase: str | None = None,
    offsets: DataFrame | None = None,
    patch: int = 64,
    tile: tuple[int, int] | None = None,
) -> DataFrame:
    """(burst_id, swath, pol, prm_date, sec_date, y, x, phase, unw_phase, coh) after multilooking.

    reference_phase: an expression over samples of a pair (y, x, ...) that is taken off, as flat earth and topography are;
    filtered: whether Goldstein's filter follows multilooking, pair by pair, in patches of `patch` samples; offsets: see
    paired_samples; tile: unwrap in two dimensions by coherence, in tiles of so many lines and samples, instead of line by line.
    """
    found = job_pairs(catalogue, job, every_burst)
    samples = materialize(paired_samples(job_samples(slc, job), found, offsets), "samples")
    looks = (job.n_rg_looks, job.n_az_looks)
    turned = samples if reference_phase is None else samples.withColumn("_reference", F.expr(reference_phase))
    ifg = cube.multilook(cube.interferogram(turned, KEY, None if reference_phase is None else "_reference"), ["re", "im"], *looks, KEY)
    if filtered:
        ifg = kernels.goldstein(ifg, patch=patch, by=KEY)
    parts = cube.densified(samples, ["i1", "q1", "i2", "q2"], KEY)
    coh = cube.multilook(cube.coherence(parts, job.coherence_window_rg, job.coherence_window_az, KEY), ["coh"], *looks, KEY)
    out = ifg.select(*KEY, "y", "x", phase(F.col("re"), F.col("im")).alias("phase")).join(coh, [*KEY, "y", "x"])
    if not unwrap:
        return out
    if tile is None:
        return kernels.unwrap_rows(out, "phase", KEY).select(*KEY, "y", "x", "phase", "unw_phase", "coh")
    out = materialize(out, "interferogram")
    return out.join(unwrapping.unwrap(out, "phase", "coh", KEY, tile), [*KEY, "y", "x"]).select(*KEY, "y", "x", "phase", "unw_phase", "coh")


def sar_slc_preprocessing(catalogue: DataFrame, slc: DataFrame, job: Job, every_burst: bool = False) -> DataFrame:
    """(burst_id, swath, pol, date, role, y, x, i, q, amplitude) of all polarizations; role tells primary from secondaries."""
    found = select_bursts(catalogue, job, every_burst)
    same = catalogue.join(maybe_broadcast(found.select(*BURST).distinct()), list(BURST), "left_semi")
    found = bursts.with_outside_primary(found, same.select(*found.columns), job.primary_date, *(t[:10] for t in job.temporal_extent))
    roles = bursts.primary_and_secondaries(found.select(*BURST, F.to_date("start").alias("date")).distinct(), job.primary_date, by=BURST)
    rows = job_samples(slc, job).join(maybe_broadcast(roles), [*BURST, "date"])
    return rows.select(*BURST, "date", "role", "y", "x", "i", "q", amplitude(F.col("i"), F.col("q")).alias("amplitude"))


def geocoded(product: DataFrame, geometry: DataFrame, resolution: float, epsg: int | None = None, looks: tuple[int, int] = (1, 1)) -> DataFrame:
    """A product on the aligned grid of a reference system: its keys, row, col and bands; wrapped phases on the circle.

    geometry: (burst_id, swath, y, x, lon, lat) of the samples, which polarizations and dates share; looks: the range and
    azimuth looks that the product has and the geometry has not. Without epsg it is the UTM zone of the middle of all.
    """
    site = ["burst_id", "swath"]
    if epsg is None:
        from burstmill.functions.geometry import utm_zone

        lon, lat = geometry.agg((F.min("lon") + F.max("lon")) / 2, (F.min("lat") + F.max("lat")) / 2).first()
        epsg = (32700 if (lat or 0) < 0 else 32600) + utm_zone(lon or 0)
    places = geometry if looks == (1, 1) else cube.multilook(geometry, ["lon", "lat"], *looks, site)
    keys = [k for k in (*KEY, "date", "role") if k in product.columns]
    bands = [c for c in product.columns if c not in (*keys, "y", "x")]
    # the geometry is solved once for each burst, whatever the number of dates, pairs and polarizations
    nodes = materialize(cube.grid_nodes(places, "lon", "lat", resolution, epsg, tuple(site)), "nodes")
    return cube.at_nodes(product, nodes, bands, tuple(keys), tuple(site), tuple(b for b in bands if b == "phase"))


#: Older names of the three processes.
ALIASES = {
    "insar_coherence": sar_coherence,
    "insar_interferogram_coherence": sar_interferogram,
    "insar_interferogram_snaphu": sar_interferogram,
    "insar_preprocessing": sar_slc_preprocessing,
    "insar_preprocessing_v02": sar_slc_preprocessing,
    "sentinel1_sar_coherence": sar_coherence,
    "sentinel1_sar_interferogram": sar_interferogram,
    "sentinel1_sar_slc_preprocessing": sar_slc_preprocessing,
}
