"""Settings of the gridded-measurement jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Where each role's variable is looked for, in order of preference.
CANDIDATES: dict[str, tuple[str, ...]] = {
    "am_value": (
        "Soil_Moisture_Retrieval_Data_AM/soil_moisture",
        "Soil_Moisture_Retrieval_Data_AM/soil_moisture_dca",
        "Soil_Moisture_Retrieval_Data_AM/soil_moisture_scah",
        "Soil_Moisture_Retrieval_Data_AM/soil_moisture_scav",
        "Geophysical_Data_AM/soil_moisture",
        "soil_moisture_am",
        "sm_am",
    ),
    "am_lon": (
        "Soil_Moisture_Retrieval_Data_AM/longitude",
        "Soil_Moisture_Retrieval_Data_AM/longitude_centroid",
        "Geolocation_Data_AM/longitude",
        "longitude",
        "lon",
    ),
    "am_lat": (
        "Soil_Moisture_Retrieval_Data_AM/latitude",
        "Soil_Moisture_Retrieval_Data_AM/latitude_centroid",
        "Geolocation_Data_AM/latitude",
        "latitude",
        "lat",
    ),
    "pm_value": (
        "Soil_Moisture_Retrieval_Data_PM/soil_moisture_pm",
        "Soil_Moisture_Retrieval_Data_PM/soil_moisture_dca_pm",
        "Soil_Moisture_Retrieval_Data_PM/soil_moisture_scah_pm",
        "Soil_Moisture_Retrieval_Data_PM/soil_moisture_scav_pm",
        "Geophysical_Data_PM/soil_moisture_pm",
        "soil_moisture_pm",
        "sm_pm",
    ),
    "pm_lon": (
        "Soil_Moisture_Retrieval_Data_PM/longitude_pm",
        "Soil_Moisture_Retrieval_Data_PM/longitude_centroid_pm",
        "Geolocation_Data_PM/longitude_pm",
        "longitude_pm",
        "lon_pm",
    ),
    "pm_lat": (
        "Soil_Moisture_Retrieval_Data_PM/latitude_pm",
        "Soil_Moisture_Retrieval_Data_PM/latitude_centroid_pm",
        "Geolocation_Data_PM/latitude_pm",
        "latitude_pm",
        "lat_pm",
    ),
}

PASSES = ("am", "pm")


@dataclass(frozen=True)
class Settings:
    """Defaults of every job; pass another instance to change them."""

    granule_pattern: str = r"(?i)\.(nc4|nc)$"
    table_pattern: str = r"(?i)\.csv$"
    date_pattern: str = r"(19|20)\d{6}"
    value_min: float = 0.0
    value_max: float = 1.0
    drop_na: bool = True
    overwrite: bool = True
    geographic_srid: int = 4326
    projected_srid: int = 6933
    cell_size: float = 9024.31
    least_rows: int = 6
    p_limit: float = 0.05
    r2_limit: float = 0.01
    reconstruction_limit: float = 1e-10
    extracted_dir: dict[str, str] = field(default_factory=lambda: {p: f"extracted/{p}" for p in PASSES})
    detrended_dir: dict[str, str] = field(default_factory=lambda: {p: f"detrended/{p}" for p in PASSES})


DEFAULT = Settings()


def candidate_table(spark: SparkSession, candidates: dict[str, tuple[str, ...]] = CANDIDATES) -> DataFrame:
    """role, rank, variable: the lists as a table, rank 0 first."""
    rows = [(role, rank, name) for role, names in candidates.items() for rank, name in enumerate(names)]
    return spark.createDataFrame(rows, "role string, rank int, variable string")
