"""Names, tokens, times and small JSON documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which a point variable may be asked for.
POINT_VARIABLES = {
    "temperature_2m": ("temperature_2m", "temperature_2m_c", "temp_2m", "temp_2m_c", "t2m", "t2m_c"),
    "dewpoint_2m": ("dewpoint_2m", "dewpoint_2m_c", "2m_dewpoint", "td2m", "td2m_c"),
    "wetbulb_2m": ("wetbulb_2m", "wetbulb_2m_c", "wet_bulb_2m", "tw2m", "tw2m_c"),
    "relative_humidity_2m": ("relative_humidity_2m", "relative_humidity_2m_pct", "rh_2m", "rh2m"),
    "wind_u_10m": ("wind_u_10m", "wind_u_10m_ms", "u10", "u10m"),
    "wind_v_10m": ("wind_v_10m", "wind_v_10m_ms", "v10", "v10m"),
    "wind_speed_10m": ("wind_speed_10m", "wind_speed_10m_ms", "10m_wind_speed", "wspd10m"),
    "wind_direction_10m": ("wind_direction_10m", "wind_direction_10m_deg", "10m_wind_direction", "wdir10m"),
    "wind_gust_10m": ("wind_gust_10m", "wind_gust_10m_ms", "10m_wind_gust", "gust"),
    "precip_accum": ("precip_accum", "precip_accum_mm", "qpf_accum", "total_qpf"),
    "precip_hourly": ("precip_hourly", "precip_hourly_mm", "qpf_hourly", "qpf_1h", "hourly_qpf"),
    "cloud_low": ("cloud_low", "cloud_low_pct", "low_cloud", "lcc"),
    "cloud_middle": ("cloud_middle", "cloud_middle_pct", "cloud_mid", "cloud_mid_pct", "mcc"),
    "cloud_high": ("cloud_high", "cloud_high_pct", "high_cloud", "hcc"),
    "mslp": ("mslp", "mslp_hpa", "mean_sea_level_pressure"),
    "vpd_2m": ("vpd", "vpd_2m", "vpd_2m_hpa", "vapor_pressure_deficit_2m"),
    "hdw": ("hdw", "hot_dry_windy"),
    "fire_weather_composite": ("fire_weather_composite", "fwc"),
}


def slug(s: Column) -> Column:
    """Lower case; every run of other characters than ASCII letters and digits is one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), F.lit("_"))


def title(s: Column) -> Column:
    """Words with their first letter in upper case, single spaces between."""
    words = F.split(F.btrim(F.regexp_replace(s, r"\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def canonical_variable(s: Column) -> Column:
    """Canonical name of a point variable's alias, or null."""
    known = F.create_map(*(F.lit(x) for name, aliases in POINT_VARIABLES.items() for a in aliases for x in (a, name)))
    return F.try_element_at(known, slug(s))


def threshold_label(t: Column) -> Column:
    text = F.format_string("%.2f", t.cast("double"))
    return F.when(F.abs(t - F.round(t)) < 1e-9, F.format_string("%.0f", t.cast("double"))).otherwise(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""))


def threshold_token(t: Column) -> Column:
    return F.replace(threshold_label(t), F.lit("."), F.lit("p"))


def sample_id(model: Column, cycle: Column, fhr: Column, place: Column) -> Column:
    return F.concat_ws("_", slug(model), F.date_format(cycle, "yyyyMMdd'_'HH'z'"), F.format_string("f%03d", fhr), slug(place))


def fetch_key(model: Column, source: Column, cycle: Column, fhr: Column, family: Column) -> Column:
    return F.concat_ws(":", model, source, F.date_format(cycle, "yyyyMMddHH"), F.format_string("f%03d", fhr), family)


def valid_time(cycle: Column, fhr: Column) -> Column:
    return cycle + F.make_dt_interval(F.lit(0), fhr.cast("int"))


def cycle_time(date: Column, hour: Column) -> Column:
    """Timestamp of a yyyymmdd text and an hour from 0 to 23; null where either is wrong."""
    good = date.rlike("^[0-9]{8}$") & hour.between(0, 23)
    return F.when(good, F.try_to_timestamp(F.concat(date, F.format_string("%02d", hour)), F.lit("yyyyMMddHH")))


def goes_time(name: Column) -> Column:
    """Start time in a file name's token s + year, day of year, hour, minute, second, tenth."""
    token = F.regexp_extract(name, r"s(\d{13})\d", 1)
    return F.when(token != "", F.try_to_timestamp(token, F.lit("yyyyDDDHHmmss")))


def age_minutes(ts: Column, ref: Column) -> Column:
    return (F.unix_micros(ref) - F.unix_micros(ts)) / 60_000_000


def forecast_hours(model: Column, cycle_hour: Column) -> Column:
    """Published forecast hours of a model's cycle; none for an unknown model."""
    seq = lambda a, b, step=1: F.sequence(F.lit(a), F.lit(b), F.lit(step))
    none = F.array().cast("array<int>")
    return (
        F.when(model == "hrrr", F.when(cycle_hour % 6 == 0, seq(0, 48)).otherwise(seq(0, 18)))
        .when(model == "gfs", F.concat(seq(0, 120), seq(123, 384, 3)))
        .when(model == "ecmwf-open-data", F.when(cycle_hour.isin(0, 12), F.concat(seq(0, 144, 3), seq(150, 360, 6))).when(cycle_hour.isin(6, 18), seq(0, 144, 3)).otherwise(none))
        .when(model == "rrfs-a", seq(0, 60))
        .when(model == "wrf-gdex", seq(0, 23))
        .otherwise(none)
    )


def short_label(site: Column, name: Column) -> Column:
    return F.substring(F.translate(F.coalesce(F.when(site != "", site), name), "_", " "), 1, 18)


def polygon_from_json(s: Column) -> Column:
    """Outer ring of a GeoJSON polygon as an array of (lat, lon); null where the text is none."""
    shape = F.from_json(s, "type string, coordinates array<array<array<double>>>")
    return F.when(shape["type"] == "Polygon", F.transform(F.get(shape["coordinates"], F.lit(0)), lambda c: F.struct(F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(0)).alias("lon"))))


def sha256(s: Column) -> Column:
    return F.sha2(s, 256)
