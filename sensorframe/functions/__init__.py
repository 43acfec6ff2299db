from .identifiers import hex_id, identifier_range_label
from .time import epoch_ms, epoch_us, format_ts, from_epoch, instant_to_ntz, ntz_to_instant, parse_ts

__all__ = [
    "epoch_ms",
    "epoch_us",
    "format_ts",
    "from_epoch",
    "hex_id",
    "identifier_range_label",
    "instant_to_ntz",
    "ntz_to_instant",
    "parse_ts",
]
