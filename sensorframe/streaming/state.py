"""The state store that operators with timers and several states need, and identifiers that share one state."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Identifiers are dealt to so many groups. A call of Python and its looks at the state cost milliseconds, so they are
#: made for a group and not for an identifier.
GROUPS = 1024


def use_rocksdb(spark: SparkSession) -> None:
    """Set the session to the RocksDB state store unless it has it; running and restarted queries keep their own."""
    if "RocksDB" not in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def group_of(id_col: str, groups: int) -> Column:
    """The group of an identifier; rows without one are apart, so that pandas keeps the type of the others."""
    return F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("int"))


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_all()


def pack_frame(frame: pd.DataFrame) -> bytes:
    """NaN stays NaN; the type of identifiers is that of their values."""
    return pack(pa.table({c: pa.array(frame[c], from_pandas=frame[c].dtype.kind != "f") for c in frame.columns}))
