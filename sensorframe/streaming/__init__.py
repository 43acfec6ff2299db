from .ingest import append_readings_stream, ingest_stream, latest_stream
from .resample import resample_stream
from .rolling import rolling_stream

__all__ = [
    "append_readings_stream",
    "ingest_stream",
    "latest_stream",
    "resample_stream",
    "rolling_stream",
]
