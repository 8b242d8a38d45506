"""Band and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names of the three products, with the two acquisition times.
PATTERNS = {
    "coherence": r"S1_coh_2images_(\d{8}T\d{6})_(\d{8}T\d{6})\.tif",
    "interferogram": r"phase_coh_(\d{8}T\d{6})_(\d{8}T\d{6})\.tif",
    "slc": r"S1_2images_(?:prm|sec)_(\d{8}T\d{6})",
}


def band_name(tag: Column) -> Column:
    """i_IW2_VV_mst_09Aug2024 -> i_VV, Unw_Phase_ifg_09Aug2024 -> Unw_Phase_ifg, lat_band -> grid_lat.

    Sub-swath, role and dates go if the name ends in one or two dates; a name without a date keeps its sub-swath.
    """
    day = r"_\d{2}[A-Z][a-z]{2}\d{4}"
    short = F.regexp_replace(tag, rf"_IW\d_([A-Z]{{2}})(?:_\w{{3,4}})?{day}(?:{day})?$", "_$1")
    short = F.regexp_replace(short, day, "")
    return F.regexp_replace(short, r"^(\w+)_band$", "grid_$1")


def described_band(name: Column, description: Column) -> Column:
    """The description instead of a default name, b1, b2 and so on."""
    return F.when(name.rlike(r"^b\d+") & description.isNotNull(), description).otherwise(name)


def file_times(name: Column, product: str) -> tuple[Column, Column]:
    """The two times in a product's file name; null where it has none."""
    pattern = PATTERNS[product]
    groups = 1 if product == "slc" else 2
    pick = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return pick(1), pick(2) if groups == 2 else F.lit(None).cast("string")


def coherence_file(prm: Column, sec: Column) -> Column:
    return F.format_string("S1_coh_2images_%s_%s.tif", F.date_format(prm, "yyyyMMdd'T'HHmmss"), F.date_format(sec, "yyyyMMdd'T'HHmmss"))


def interferogram_file(prm: Column, sec: Column) -> Column:
    return F.format_string("phase_coh_%s_%s.tif", F.date_format(prm, "yyyyMMdd'T'HHmmss"), F.date_format(sec, "yyyyMMdd'T'HHmmss"))


def slc_file(role: str, date: Column, pol: Column, band: Column) -> Column:
    """role: prm or sec; the polarization is always part of the name."""
    return F.format_string(f"S1_2images_{role}_%s_%s_%s.tif", F.date_format(date, "yyyyMMdd'T'HHmmss"), pol, band)


def slugify(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), F.lit("_"))


def quoted(text: Column) -> Column:
    """URL quoting with %20 for spaces."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def last_json(text: Column) -> Column:
    """The last JSON object that starts a line of mixed output."""
    return F.regexp_extract(text, r"(?s).*(?:^|\n)(\{.*\})", 1)


def band_kind(name: Column) -> Column:
    """Which product a band belongs to, by its prefix; null for others."""
    kinds = {"Phase": "wrapped", "Unw": "unwrapped", "coh": "coherence", "elevation": "elevation"}
    found = F.lit(None).cast("string")
    for prefix, kind in kinds.items():
        found = F.when(name.startswith(prefix), kind).otherwise(found)
    return found


def unwrap_command(conf: Column) -> Column:
    """The command that an unwrapper's configuration text names: of its comment lines the first that begins with snaphu."""
    return F.nullif(F.regexp_extract(conf, r"(?m)^#\s*(snaphu .*?)\s*$", 1), F.lit(""))
