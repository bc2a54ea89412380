"""Schemas of the tables that the jobs read and write."""

from __future__ import annotations

ARRAYS = "granule string, variable string, dims array<int>, chunk int, data array<double>"
ATTRIBUTES = "granule string, variable string, attr string, `values` array<double>"
EXTRACTED = "source_file string, date_tag string, pass string, lon double, lat double, soil_moisture double"
CELLS = (
    "source_file string, date_tag string, pass string, lon double, lat double, x double, y double, "
    "soil_moisture double, trend_hat double, resid double, sm_for_kriging double, trend_removed boolean, "
    "p_trend double, r2_trend double, trend_ind int, pixel_id int, geometry binary, srid int"
)
EXTRACT_LOG = "source_file string, pass string, rows int, output_file string, status string"
DETREND_LOG = EXTRACT_LOG.replace(", status string", "") + ", trend_removed boolean, p_trend double, r2_trend double, status string, note string"
REQUIRED = ("source_file", "date_tag", "pass", "lon", "lat", "soil_moisture")
