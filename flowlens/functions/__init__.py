"""Column functions: text, time, buckets, safe arithmetic."""

from .scalars import bucket_counts, bucket_of, clamp, floor_divide, register_functions, safe_divide, sigmoid, strip, strip_string
from .times import from_epoch_us, logical_time, parse_timestamp, time_us, timestamp_value

__all__ = ["bucket_counts", "bucket_of", "clamp", "floor_divide", "from_epoch_us", "logical_time", "parse_timestamp", "register_functions", "safe_divide", "sigmoid", "strip", "strip_string", "time_us", "timestamp_value"]
