"""Fixed schemas of the domain tables."""

from pyspark.sql import types as T

SIGHTING = T.StructType([
    T.StructField("device", T.StringType()),
    T.StructField("rssi", T.DoubleType()),
    T.StructField("ts", T.LongType()),
    T.StructField("ap", T.StringType()),
])

AP_DIM = T.StructType([
    T.StructField("ap", T.StringType()),
    T.StructField("site_id", T.IntegerType()),
    T.StructField("side", T.StringType()),
    T.StructField("pos_code", T.StringType()),
])

ACTION_DIM = T.StructType([
    T.StructField("action_code", T.IntegerType()),
    T.StructField("action_type", T.StringType()),
])

STATIC_DEVICES = T.StructType([T.StructField("device", T.StringType())])

VISIT = T.StructType([
    T.StructField("device", T.StringType()),
    T.StructField("site_id", T.IntegerType()),
    T.StructField("start_ts", T.LongType()),
    T.StructField("end_ts", T.LongType()),
])

RESULT = T.StructType([
    T.StructField("site_id", T.IntegerType()),
    T.StructField("value", T.LongType()),
    T.StructField("mon_time", T.LongType()),
])

# The action codes of the domain.
ACTIONS = [
    (0, "进入大楼"),
    (1, "离开大楼"),
    (2, "路人"),
    (3, "在楼内走动"),
    (4, "其他"),
]

# Field order of each text layout, separated by "|".
LAYOUTS = {
    "scan": ["device", "rssi", "ts"],              # access point is in the path
    "v4": ["device", "rssi", "ts", "ap"],
    "v5": ["seq", "device", "rssi", "ts", "ap"],
    "series": ["device", "ts", "rssi", "ap"],
}

# Default thresholds of the operators.
RSSI_FLOOR = -90.0
RECENT_SECONDS = 300
SLICE_GAP = 120
VISIT_GAP = 1800
PASSER_BY_SECONDS = 6
ALWAYS_ON_HOURS = 24
BUCKET_SECONDS = 300
IDLE_SECONDS = 9273
LOCAL_ZONE = "+08:00"
DAY_WINDOW_OFFSET = "16 hours"
