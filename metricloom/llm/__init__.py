"""Operations of large-scale training-data pipelines. Nothing outside this subpackage imports it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("p1_percentiles", "p2_spans", "p3_subset", "p4_clusters", "p4_spectral", "p5_neighbours", "p6_tokens", "p7_mix", "p8_reading")

QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    _x = import_module(f"{__name__}.{_m}")
    QUERIES |= _x.QUERIES
    ORACLES |= _x.ORACLES
