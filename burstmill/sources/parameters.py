"""Job documents: one JSON object, from a file or as base64 text, with fixed types; nothing is inferred."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from burstmill.operators.bursts import PAGE  # noqa: F401  re-exported for callers that set up searches

SCHEMA = (
    "temporal_extent array<string>, temporal_baseline int, InSAR_pairs array<array<string>>, primary_date string, burst_id bigint, "
    "spatial_extent struct<west:double,east:double,south:double,north:double>, polarization array<string>, sub_swath string, "
    "coherence_window_rg int, coherence_window_az int, n_rg_looks int, n_az_looks int"
)
POLARIZATIONS, SWATHS = ("VV", "VH"), ("IW1", "IW2", "IW3")


@dataclass(frozen=True)
class Job:
    """Parameters of a workflow. An explicit null is the same as a missing key; unknown keys are ignored."""

    temporal_extent: list[str] | None = None
    temporal_baseline: int | None = None
    InSAR_pairs: list[list[str]] = field(default_factory=list)
    primary_date: str | None = None
    burst_id: int | None = None
    spatial_extent: dict | None = None
    polarization: list[str] = field(default_factory=lambda: ["VV"])
    sub_swath: str | None = None
    coherence_window_rg: int = 10
    coherence_window_az: int = 2
    n_rg_looks: int = 4
    n_az_looks: int = 1


#: Older names of parameters.
ALIASES = {"master_date": "primary_date", "sub_swath_id": "sub_swath"}


def job(document: dict, **defaults: object) -> Job:
    """A validated Job. Windows and looks count in pairs: if one of the two is missing, both take their defaults."""
    known = {f.name for f in fields(Job)}
    given = {ALIASES.get(k, k): v for k, v in document.items() if v is not None}
    given = defaults | {k: v for k, v in given.items() if k in known}
    for a, b in (("coherence_window_rg", "coherence_window_az"), ("n_rg_looks", "n_az_looks")):
        if (a in given) != (b in given):
            given.pop(a, None), given.pop(b, None)
    pol = given.get("polarization", ["VV"])
    given["polarization"] = [p.upper() for p in ([pol] if isinstance(pol, str) else pol)]
    pairs = given.get("InSAR_pairs", [])
    given["InSAR_pairs"] = [pairs] if pairs and isinstance(pairs[0], str) else pairs
    wrong = [p for p in given["polarization"] if p not in POLARIZATIONS]
    if wrong or given.get("sub_swath") and given["sub_swath"].upper() not in SWATHS:
        raise ValueError(f"unknown polarization or sub-swath: {wrong or given['sub_swath']}")
    if given.get("burst_id") is None and given.get("spatial_extent") is None:
        raise ValueError("burst_id or spatial_extent is needed")
    return Job(**given)


def read_job(text: str, **defaults: object) -> Job:
    """text: a path to a JSON file, or the document in base64."""
    try:
        raw = base64.b64decode(text, validate=True)
        return job(json.loads(raw), **defaults)
    except ValueError:
        with open(text) as f:
            return job(json.load(f), **defaults)


def document(text: Column) -> Column:
    """A column of base64 documents as structs; a polarization given as one text becomes a list."""
    plain = F.unbase64(text).cast("string")
    one = F.get_json_object(plain, "$.polarization")
    found = F.from_json(plain, SCHEMA)
    return found.withField("polarization", F.when(one.startswith("["), F.from_json(one, "array<string>")).when(one.isNotNull(), F.array(one)))
