"""Schemas, and the fixed tables of the domain."""

from pyspark.sql import types as T

# Concentration bands (low, high) and their index bands (low, high), by pollutant.
BREAKPOINTS = {
    "pm2.5": [(0.0, 9.0, 0, 50), (9.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 125.4, 151, 200), (125.5, 225.4, 201, 300), (225.5, 325.4, 301, 500)],
    "pm10": [(0.0, 54.0, 0, 50), (55.0, 154.0, 51, 100), (155.0, 254.0, 101, 150), (255.0, 354.0, 151, 200), (355.0, 424.0, 201, 300), (425.0, 604.0, 301, 500)],
    "ozone": [(0.0, 0.054, 0, 50), (0.055, 0.070, 51, 100), (0.071, 0.085, 101, 150), (0.086, 0.105, 151, 200), (0.106, 0.200, 201, 300)],
    "no2": [(0.0, 53.0, 0, 50), (54.0, 100.0, 51, 100), (101.0, 360.0, 101, 150), (361.0, 649.0, 151, 200), (650.0, 1249.0, 201, 300), (1250.0, 2049.0, 301, 500)],
    "co": [(0.0, 4.4, 0, 50), (4.5, 9.4, 51, 100), (9.5, 12.4, 101, 150), (12.5, 15.4, 151, 200), (15.5, 30.4, 201, 300), (30.5, 50.4, 301, 500)],
}
# Index levels, upper bound and label.
LEVELS = [(50, "Good"), (100, "Moderate"), (150, "Sensitive Groups"), (200, "Unhealthy"), (300, "Very Unhealthy"), (500, "Hazardous")]
# Colours by place in the palette; 0 is unknown.
PALETTE = ["#cccccc", "#00FFFF", "#00CCFF", "#0099FF", "#00E400", "#009900", "#006600", "#FFFF00", "#FF7E00", "#FF0000", "#8F3F97", "#7E0023"]
# Upper bound of a concentration and its place in the palette; above all of them it is 11.
COLOR_BANDS = {
    "pm2.5": [(2.0, 1), (5.0, 2), (9.0, 4), (35.4, 7), (55.4, 8), (125.4, 9), (225.4, 10)],
    "pm10": [(15.0, 1), (30.0, 2), (40.0, 3), (54.0, 4), (154.0, 7), (254.0, 8), (354.0, 9), (424.0, 10)],
    "ozone": [(15.0, 2), (25.0, 3), (35.0, 5), (54.0, 6), (70.0, 7), (85.0, 8), (105.0, 9), (200.0, 10)],
    "no2": [(20.0, 2), (35.0, 3), (53.0, 4), (100.0, 7), (360.0, 8), (649.0, 9), (1249.0, 10)],
    "co": [(1.5, 2), (3.0, 3), (4.4, 4), (9.4, 7), (12.4, 8), (15.4, 9), (30.4, 10)],
}
# Plausible concentrations; clamps of the raw mobile feed; thresholds of a trend.
PLAUSIBLE = {"pm2.5": (0.0, 999.0), "pm10": (0.0, 2000.0), "ozone": (0.0, 600.0), "no2": (0.0, 2100.0), "co": (0.0, 60.0)}
FEED_CLAMP = {"pm2.5": (0.0, 999.0), "pm10": (0.0, 2000.0), "ozone": (0.0, 200.0)}
TREND_THRESHOLD = {"pm2.5": 1.0, "pm10": 2.0, "ozone": 2.0}
# Spellings of the pollutants.
SPELLINGS = {
    "pm2.5": ["pm25", "pm2.5", "pm2_5", "pm2-5", "pm 2.5"], "pm10": ["pm10", "pm 10"], "ozone": ["ozne", "ozone", "o3"],
    "no2": ["no2", "nitrogen dioxide"], "co": ["co", "carbon monoxide"],
}
# Which of a sensor's pollutants comes first.
PRIORITY = ["PM25", "PM2.5", "PM10", "OZNE", "Ozone", "NO2", "CO"]
# Upper bounds of the categories of fields, by concentration and by index; colours for detecting changes.
FIELD_TOPS = [2.0, 5.0, 9.0, 35.4, 55.4, 125.4, 225.4]
AQI_TOPS = [6.0, 19.0, 50.0, 100.0, 150.0, 200.0, 300.0]
SENTINEL_BANDS = [(2.0, "#00FFFF"), (9.0, "#00E400"), (35.4, "#FFFF00"), (55.4, "#FF7E00"), (125.4, "#FF0000"), (225.4, "#8F3F97")]
# Stops of the continuous colours, by concentration and by index.
PM25_RAMP = [
    (0.0, (0, 255, 255)), (1.0, (0, 255, 255)), (3.5, (0, 204, 255)), (7.0, (0, 228, 0)), (22.2, (255, 255, 0)),
    (45.4, (255, 126, 0)), (90.4, (255, 0, 0)), (175.4, (143, 63, 151)), (250.0, (126, 0, 35)), (500.0, (126, 0, 35)),
]
AQI_RAMP = [
    (0.0, (0, 255, 255)), (6.0, (0, 255, 255)), (19.0, (0, 204, 255)), (50.0, (0, 228, 0)), (51.0, (255, 255, 0)), (100.0, (255, 255, 0)),
    (101.0, (255, 126, 0)), (150.0, (255, 126, 0)), (151.0, (255, 0, 0)), (200.0, (255, 0, 0)), (201.0, (143, 63, 151)), (300.0, (143, 63, 151)), (500.0, (126, 0, 35)),
]
# Codes of counties; words of the vendor in names.
COUNTY_FIPS = {
    "beaver": 49001, "box elder": 49003, "cache": 49005, "carbon": 49007, "daggett": 49009, "davis": 49011, "duchesne": 49013, "emery": 49015,
    "garfield": 49017, "grand": 49019, "iron": 49021, "kane": 49025, "millard": 49027, "morgan": 49029, "piute": 49031, "rich": 49033,
    "salt lake": 49035, "san juan": 49023, "sanpete": 49039, "san pete": 49039, "sevier": 49041, "summit": 49043, "tooele": 49045, "uintah": 49047,
    "utah": 49049, "wasatch": 49051, "washington": 49053, "wayne": 49055, "weber": 49057,
}
VENDOR_SUFFIX = r"(?i)(?:\s*-\s*|\s+)power(?:ed)?\s+by\s+uto[pi]{2}a(?:\s+fiber)?"

READINGS = T.StructType([
    T.StructField("sensor_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("pollutant", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("meta", T.StringType()),
])
