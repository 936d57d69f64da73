"""Fixed values that results depend on.

These are part of the analysis definition (column names of the two source
shapes, recode labels, hour windows, age breaks); they are stated here once,
in natural order, and every operator reads them from this module.
"""

# --- fixed values: legacy ("2019") source -> canonical column names -------
LEGACY_RENAMES = {
    "bikeid": "bike_id",
    "from_station_id": "start_station_id",
    "from_station_name": "start_station_name",
    "to_station_id": "end_station_id",
    "to_station_name": "end_station_name",
    "usertype": "user_type",
    "birthyear": "birth",
    "tripduration": "duration_sec",
}

# --- fixed values: modern ("2020") source -> canonical column names -------
MODERN_RENAMES = {
    "ride_id": "trip_id",
    "started_at": "start_time",
    "ended_at": "end_time",
    "member_casual": "user_type",
}
MODERN_DROPPED = ("rideable_type",)

# --- fixed values: legacy user-type labels -> canonical labels ------------
# Anything else (including NULL) becomes NULL.
USER_TYPE_RECODE = {"Subscriber": "member", "Customer": "casual"}

# --- fixed values: peak-hour windows, inclusive [first_hour, last_hour] ----
PEAK_WINDOWS = ((7, 9), (15, 18))

# --- fixed values: age bins, left-closed [a, b); outside -> NULL ----------
AGE_BREAKS = (0, 18, 25, 35, 45, 55, 65, 120)
# coarse demographic bands 18-24, 25-34, 35-44, 45-54, 55+
AGE_BREAKS_COARSE = (18, 25, 35, 45, 55, None)

# --- fixed values: thresholds used in the profile ------------------------
IQR_K = 1.5                      # Tukey fence multiplier
PEAK_CUTOFF_PCT = 35.55          # share of the busiest hour that marks a peak hour
ADJACENT_DELTA_PCT = 2.0         # adjacent-hour change below which the curve is flat
FLAT_RUN = 2                     # flat steps in a row that make a break point of the curve
MONTH_SECONDS = 30 * 86400       # "more than one month"
MAX_PLAUSIBLE_AGE = 98
BIRTH_YEAR_RANGE = (1925, 2019)  # birth years outside are a logical issue
AS_OF_YEAR = 2019                # age = AS_OF_YEAR - birth
LEGACY_YEAR = 2019
MODERN_YEAR = 2020
DURATION_HIST_BINS = 30
ROUTE_HIST_BINS = 50
TOP_ROUTES = 10
