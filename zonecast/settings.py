"""Defaults of the operators. Every operator takes these as parameters."""

# Results only agree when these stay as they are.
TIMEZONE = "America/New_York"
BOROUGHS = ("Bronx", "Brooklyn", "Manhattan", "Queens", "Staten Island")
ZONE_ID_RANGE = (1, 263)
PANEL_ZONE_ID_RANGE = (2, 263)
TRIP_COLUMNS = (
    "tpep_pickup_datetime",
    "tpep_dropoff_datetime",
    "PULocationID",
    "DOLocationID",
    "passenger_count",
    "trip_distance",
    "fare_amount",
    "payment_type",
)
DELAYS = (0, 1, 3, 6)
LAGS = (1, 2, 3, 24, 168)
MEAN_WIDTHS = (3, 24, 168)
STD_WIDTH = 24
MORNING_EVENING_RUSH = (7, 8, 9, 16, 17, 18)
NUMERIC_FEATURES = (
    "lag_1",
    "lag_2",
    "lag_3",
    "lag_24",
    "lag_168",
    "rolling_mean_3",
    "rolling_mean_24",
    "rolling_mean_168",
    "rolling_std_24",
    "trend_1",
    "hour_sin",
    "hour_cos",
    "weekday_sin",
    "weekday_cos",
    "weekend",
    "month",
    "rush_hour",
)
REFERENCE_WEEKS = (1, 2, 3, 4)
WARMUP_HOURS = 168
STUDY_WARMUP_HOURS = 174
STUDY_EMBARGO_HOURS = 6
SPARSE_ZONE_MEAN_MAX = 1.0
SLICE_DIMENSIONS = (
    "borough",
    "local_hour",
    "weekend",
    "rush_hour",
    "zone_cohort",
    "target_cohort",
)
BASELINES = (
    "previous_hour",
    "previous_day_24h",
    "previous_week_168h",
    "zone_hour_average",
    "rolling_mean_24h",
)
BAND_PROBABILITIES = (0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)
WEATHER_FIELDS = {
    "temperature": "temperature_c",
    "dew_point_temperature": "dew_point_c",
    "wind_speed": "wind_speed_m_s",
}
WEATHER_VALUES = tuple(WEATHER_FIELDS.values())
AUDITED_FIELDS = (*WEATHER_FIELDS, "precipitation")
ATTRIBUTE_SUFFIXES = ("_Source_Code", "_Quality_Code", "_Measurement_Code", "_Report_Type")
ISO_SECONDS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"
PRIMARY_SOURCE, PRIMARY_QUALITY = "223", "1"
PRIMARY_REPORTS = ("FM12", "FM15", "FM16")
WIND_MEASUREMENTS = ("C", "N", "V")
HOURLY_SOURCE, HOURLY_REPORTS = "413", ("FM15", "FM16")
SYNOPTIC_SOURCE, SYNOPTIC_REPORTS = "412", ("FM12", "FM94_1")
QUALITY_STATES = ("good", "unverified", "rejected", "missing")
BUNDLE_MAX_AGE_HOURS = 12
EXPORT_COLUMNS = (
    "study_id",
    "scope",
    "time_utc",
    "zone_id",
    "zone_name",
    "borough",
    "model",
    "recorded_pickups",
    "estimate",
    "error_estimate_minus_recorded",
    "absolute_error",
)
BOOSTING = {"rounds": 120, "rate": 0.08, "bins": 255, "l2": 1.0}
RIDGE_ALPHA = 10.0
