"""Types and limits of the data model. Time is signed 64-bit nanoseconds, never a timestamp, which has microseconds."""

POINTS = "uuid string, time long, value double, seq long"
WINDOWS = "uuid string, time long, min double, mean double, max double, count long"
RANGES = "uuid string, start long, end long"
STREAMS = "uuid string, collection string, tags map<string,string>, annotations map<string,string>, annotation_version long"

# The time domain, first version and write limits.
MIN_TIME, MAX_TIME = -(16 << 56), 48 << 56
CREATED_VERSION = 10
MAX_INSERT, BUFFER_LIMIT = 25_000, 32_768
NODE_WIDTHS = (0, 2, 8, 14, 20, 26, 32, 38, 44, 50, 56)
