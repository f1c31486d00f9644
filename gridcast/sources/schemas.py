"""Column names and types of the files the pipeline reads and writes."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(*columns: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in columns])


def _doubles(*names: str) -> list[tuple[str, object]]:
    return [(n, DoubleType()) for n in names]


MINUTE_MEASURES = (
    "temperature",
    "precipitation",
    "wind_degree",
    "wind_speed",
    "air_pressure",
    "sea_level_pressure",
    "humidity",
    "solar_radiation",
    "solar_intensity",
)

# measures that are counters within the day: the step between buckets is used
DIFFERENCED = ("precipitation", "solar_radiation", "solar_intensity")

PROFILE_MEASURES = ("temperature", "precipitation", "wind_degree", "wind_speed", "humidity")

WEATHER_MINUTE = _schema(("series_id", StringType()), ("ts", TimestampNTZType()), *_doubles(*MINUTE_MEASURES))

WEATHER_HOURLY = _schema(("ts", TimestampNTZType()), *_doubles(*PROFILE_MEASURES))

SOLAR_OUTPUT_TEXT = _schema(("datetime", StringType()), *_doubles("result"))

DAILY_TEMPERATURE = _schema(
    ("date", DateType()), ("location", StringType()), *_doubles("avgTemp", "minTemp", "maxTemp")
)

DAILY_PRECIPITATION = _schema(("date", DateType()), ("location", StringType()), *_doubles("precipitation"))

TRAINING_SET = _schema(
    ("ts", TimestampNTZType()),
    *_doubles("result", *MINUTE_MEASURES),
    ("date", IntegerType()),
    ("month", IntegerType()),
    ("hour", IntegerType()),
    *_doubles("difference"),
)

MODEL_FEATURES = (
    "temperature",
    "wind_speed",
    "humidity",
    "solar_radiation",
    "solar_intensity",
    "date",
    "month",
    "hour",
    "difference",
)

# Headers of the station files, in file order, and our names.
# One mapping serves training and forecast: 일사 is radiation, 일조 sunshine.
MINUTE_HEADERS = {
    "지점": "series_id",
    "일시": "ts",
    "기온(°C)": "temperature",
    "강수량(mm)": "precipitation",
    "풍향(deg)": "wind_degree",
    "풍속(m/s)": "wind_speed",
    "현지기압(hPa)": "air_pressure",
    "해면기압(hPa)": "sea_level_pressure",
    "습도(%)": "humidity",
    "일사(MJ/m^2)": "solar_radiation",
    "일조(Sec)": "solar_intensity",
}

HOURLY_HEADERS = {
    "일시": "ts",
    "기온(°C)": "temperature",
    "강수량(mm)": "precipitation",
    "풍향(16방위)": "wind_degree",
    "풍속(m/s)": "wind_speed",
    "습도(%)": "humidity",
}
