"""Fixed values.

Everything here must keep these exact values for the results to be right:
labels, weights, codes, thresholds and word lists.
"""

# Delay thresholds in minutes and the five bins they bound.
THRESHOLDS = (15, 30, 45, 60)
BIN_LABELS = ("< 15 min", "15–30 min", "30–45 min", "45–60 min", "≥ 60 min")
BIN_MINUTES = (7.5, 22.5, 37.5, 52.5, 75.0)
SEVERITY_WEIGHTS = (0.0, 1.0, 2.0, 3.0, 4.0)
RISK_WEIGHTS = (0.00, 0.25, 0.50, 0.75, 1.00)

# Upper bounds (exclusive) and names of the severity bands, last name is open ended.
SEVERITY_BANDS = ((0.9, "Safe"), (1.8, "Mild"), (2.7, "Caution"), (3.6, "High"))
SEVERITY_TOP = "Dangerous"
RISK_BANDS = ((20, "Safe"), (40, "Mild"), (60, "Caution"))
RISK_TOP = "High risk"

# Rolling windows in days.
DEPARTURE_WINDOWS = (7, 14, 21, 28)
ARRIVAL_WINDOWS = (7, 14)
ROLLUP_WINDOWS = (1, 7, 14)

# Texts that mean "no tail number", and texts that mean "no category".
TAIL_SENTINELS = ("", "NAN", "NONE", "NULL", "UNKNOWN", "UNKN", "NA")
CATEGORY_SENTINELS = ("", "nan", "none")

# Airline names (lower case) and their codes.
AIRLINE_NAMES = {
    "southwest": "WN",
    "southwest airlines": "WN",
    "american": "AA",
    "american airlines": "AA",
    "delta": "DL",
    "delta air lines": "DL",
    "united": "UA",
    "united airlines": "UA",
    "jetblue": "B6",
    "alaska": "AS",
    "spirit": "NK",
    "frontier": "F9",
}

# Marketing carrier names as price feeds write them, and their codes.
MARKETING_NAMES = {
    "American Airlines": "AA",
    "Delta Air Lines": "DL",
    "United Airlines": "UA",
    "Southwest Airlines": "WN",
    "Alaska Airlines": "AS",
    "JetBlue": "B6",
    "Spirit Airlines": "NK",
    "Frontier Airlines": "F9",
    "Hawaiian Airlines": "HA",
    "British Airways": "BA",
    "Iberia": "IB",
    "Finnair": "AY",
    "Turkish Airlines": "TK",
    "TAP AIR PORTUGAL": "TP",
    "Royal Air Maroc": "AT",
}

# Explanation texts, and the values from which they apply.
NO_REASON = "no strong delay signals detected"
REASON_LOW_SUPPORT = "limited flight-number history"
REASON_FLIGHT = "this flight/route often departs late"
REASON_CARRIER = "carrier delays elevated recently"
REASON_STATION = "origin station running late recently"
REASON_CONGESTION = "busy origin (recent congestion)"
REASON_LOAD = "typically high load factor (prior month)"
REASON_WEATHER = "weather that day"
REASON_MEAN_DELAY = 10
REASON_CONGESTION_COUNT = 30
REASON_LOAD_FACTOR = 0.85

# Weights of phrases in a page's title, and of the airport code in title and snippet.
PAGE_TITLE_WEIGHTS = (("airport", 2.0), ("international airport", 0.5), ("list of", -2.0))
PAGE_CODE_IN_TITLE = 0.3
PAGE_CODE_IN_SNIPPET = 0.2

# Weather variables of the daily and the hourly feed.
DAILY_WEATHER = (
    "temperature_2m_max", "temperature_2m_min", "precipitation_sum",
    "windspeed_10m_max", "windgusts_10m_max", "weathercode",
)
HOURLY_WEATHER = ("temperature_2m", "precipitation", "windspeed_10m", "weathercode")
KELVIN_OFFSET = 273.15

# Columns kept when flights are pruned.
PRUNED_COLUMNS = (
    "FlightDate", "Reporting_Airline", "Flight_Number_Reporting_Airline", "Origin", "Dest",
    "CRSDepTime", "CRSArrTime", "DepDelayMinutes", "ArrDelayMinutes", "DepDel15", "ArrDel15",
    "Tail_Number", "AirTime", "WheelsOff", "WheelsOn", "TaxiOut", "TaxiIn", "DepTimeBlk",
)

# Columns kept from a monthly flight file.
MONTHLY_COLUMNS = (
    "Year", "Quarter", "Month", "DayofMonth", "DayOfWeek", "FlightDate", "Marketing_Airline_Network",
    "Operated_or_Branded_Code_Share_Partners", "DOT_ID_Marketing_Airline", "IATA_Code_Marketing_Airline",
    "Flight_Number_Marketing_Airline", "Originally_Scheduled_Code_Share_Airline",
    "DOT_ID_Originally_Scheduled_Code_Share_Airline", "IATA_Code_Originally_Scheduled_Code_Share_Airline",
    "Flight_Num_Originally_Scheduled_Code_Share_Airline", "Operating_Airline", "DOT_ID_Operating_Airline",
    "IATA_Code_Operating_Airline", "Tail_Number", "Flight_Number_Operating_Airline", "OriginAirportID",
    "OriginAirportSeqID", "OriginCityMarketID", "Origin", "OriginCityName", "OriginState", "OriginStateFips",
    "OriginStateName", "OriginWac", "DestAirportID", "DestAirportSeqID", "DestCityMarketID", "Dest",
    "DestCityName", "DestState", "DestStateFips", "DestStateName", "DestWac", "CRSDepTime", "DepTime",
    "DepDelay", "DepDelayMinutes", "DepDel15", "DepartureDelayGroups", "DepTimeBlk", "TaxiOut", "WheelsOff",
    "WheelsOn", "TaxiIn", "CRSArrTime", "ArrTime", "ArrDelay", "ArrDelayMinutes", "ArrDel15",
    "ArrivalDelayGroups", "ArrTimeBlk", "Cancelled", "CancellationCode", "Diverted", "CRSElapsedTime",
    "ActualElapsedTime", "AirTime", "Flights", "Distance", "DistanceGroup", "CarrierDelay", "WeatherDelay",
    "NASDelay", "SecurityDelay", "LateAircraftDelay", "FirstDepTime", "TotalAddGTime", "LongestAddGTime",
)

# Where carrier and flight number come from when the plain columns are absent.
CARRIER_ALIASES = (
    "IATA_Code_Operating_Airline", "Operating_Airline",
    "IATA_Code_Marketing_Airline", "Marketing_Airline_Network",
)
FLIGHT_NUMBER_ALIASES = ("Flight_Number_Operating_Airline", "Flight_Number_Marketing_Airline")

# Model features.
CATEGORICAL_FEATURES = (
    "Origin", "Dest", "od_pair", "Reporting_Airline", "dep_dow", "sched_dep_hour", "is_holiday",
    "aircraft_type", "origin_daily_weathercode", "origin_dep_hour_weathercode",
    "has_recent_arrival_turn_5h",
)
WEATHER_FEATURES = (
    "origin_temp_max_K", "origin_temp_min_K", "origin_daily_precip_sum_mm",
    "origin_daily_windspeed_max_kmh", "origin_dep_temp_K", "origin_dep_precip_mm",
    "origin_dep_windspeed_kmh",
)
HOURLY_WEATHER_FEATURES = (
    "origin_dep_temp_K", "origin_dep_precip_mm", "origin_dep_windspeed_kmh",
    "origin_dep_hour_weathercode",
)

# Count patterns, most explicit first; {noun} is filled in by the caller.
COUNT_PATTERNS = (
    (r"\btotal of\s+(\d{1,4})\s+{noun}\b", "total_of_{noun}", 0.95),
    (r"\ba total\s+(\d{1,4})\s+{noun}\b", "a_total_{noun}", 0.90),
    (r"\bhas\s+(\d{1,4})\s+{noun}\b", "has_{noun}", 0.75),
    (r"\bwith\s+(\d{1,4})\s+{noun}\b", "with_{noun}", 0.60),
)

# Collector slots (local time) and the spread after each in minutes.
COLLECTOR_SLOTS = ("08:00", "16:00", "23:50")
COLLECTOR_SPREAD_MINUTES = 20

# Columns of the airport table.
AIRPORT_COLUMNS = ("IATA", "ICAO", "AirportName", "City", "State", "Country", "Latitude", "Longitude", "Timezone")

# Columns that departure and arrival features are matched by when there is no row id.
MERGE_KEYS = (
    "FlightDate", "Reporting_Airline", "Flight_Number_Reporting_Airline", "Origin", "Dest", "CRSDepTime", "CRSArrTime",
)

# Columns that are read as numbers.
NUMERIC_COLUMNS = (
    "CRSDepTime", "CRSArrTime", "DepDelayMinutes", "ArrDelayMinutes", "DepDel15", "ArrDel15", "AirTime", "WheelsOff",
    "WheelsOn", "TaxiOut", "TaxiIn", "Flight_Number_Reporting_Airline",
)

# Columns of the history pool.
HISTORY_COLUMNS = (
    "FlightDate", "Origin", "Dest", "Reporting_Airline", "Flight_Number_Reporting_Airline", "DepDelayMinutes", "DepDel15",
    "ArrDelayMinutes", "CRSDepTime", "CRSArrTime", "dep_dt_local", "dep_local_date", "arr_dt_local", "arr_local_date",
    "dep_utc", "arr_utc", "AirTime", "WheelsOff", "WheelsOn", "TaxiOut", "TaxiIn",
)
