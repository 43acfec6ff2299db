from .kept_catalog import KeptCatalog
from .logs import classify, metric_kinds, read_logs, read_raw_logs, to_readings
from .messages import (
    decode_payloads,
    encode_payloads,
    land_messages,
    latest_batch_per_topic,
    message_stream,
    route_topics,
    sensors,
    topic_filter,
)

__all__ = [
    "KeptCatalog",
    "classify",
    "decode_payloads",
    "encode_payloads",
    "land_messages",
    "latest_batch_per_topic",
    "message_stream",
    "metric_kinds",
    "read_logs",
    "read_raw_logs",
    "route_topics",
    "sensors",
    "to_readings",
    "topic_filter",
]
