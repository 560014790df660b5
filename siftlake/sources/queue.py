"""The document queue: requests in, messages out, in JSON or in the queue's binary form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.schemas import PAYLOAD

#: Field numbers of the binary message, and the codes of its status.
FIELDS = {"site_id": 1, "id": 2, "text": 3, "extra": 4, "timestamp_millis": 5, "retry_count": 6, "max_retries": 7, "status": 8, "error_message": 9, "last_retry_timestamp": 10, "language": 11}
STATUS = ("PENDING", "PROCESSING", "COMPLETED", "FAILED", "DEAD_LETTER")
_TEXT = {"text", "error_message", "language"}
_NAMES = {n: k for k, n in FIELDS.items()}
_SMALL = {"site_id", "id", "retry_count", "max_retries", "status"}


def store_requests(bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(a row per document of each request: id, text, language, extra; requests that can't be read or have none).

    Unknown fields are left out, a missing id is 0.
    """
    read = bodies.withColumn("_items", F.from_json(body, "array<struct<id:int,text:string,language:string,extra:map<string,string>>>"))
    ok = F.coalesce(F.size("_items") > 0, F.lit(False)) & F.forall(F.coalesce("_items", F.array()), lambda x: x.isNotNull())
    keep = [c for c in bodies.columns if c != body]
    documents = read.filter(ok).select(*keep, F.inline("_items")).withColumn("id", F.coalesce("id", F.lit(0)))
    return documents, read.filter(~ok).drop("_items")


def publish(messages: DataFrame, path: str, stream: bool = False, checkpoint: str | None = None):
    """Messages as JSON lines for the queue's folder; for a stream the started query."""
    out = messages.select(F.to_json(F.struct(*PAYLOAD.names)).alias("value"))
    if stream:
        return out.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return out.write.mode("append").text(path)


def subscribe(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """The raw messages (value) of a queue's folder as a stream; each file is read once, also over restarts from a checkpoint.
    At most so many files a batch, else all that are new."""
    reader = spark.readStream.format("text").schema("value string")
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).load(path)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _sized(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def pack(message: dict) -> bytes:
    """A message's bytes; empty and zero fields are left out, map entries stand in the order of their keys."""
    out = []
    for name, number in FIELDS.items():
        value = message.get(name)
        if name == "extra":
            out += [_sized(number, _sized(1, k.encode()) + _sized(2, (v or "").encode())) for k, v in sorted(dict(value or {}).items())]
        elif name in _TEXT:
            out += [_sized(number, value.encode())] if value else []
        else:
            n = STATUS.index(value or "PENDING") if name == "status" else int(value or 0)
            out += [_varint(number << 3) + _varint(n)] if n else []
    return b"".join(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _fields(data: bytes):
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        if tag & 7 == 0:
            value, at = _read_varint(data, at)
        elif tag & 7 == 2:
            n, at = _read_varint(data, at)
            if at + n > len(data):
                raise ValueError("message ends early")
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("unknown wire type")
        yield tag >> 3, value


def unpack(data: bytes) -> dict:
    """The reverse; fields that are unknown are left out."""
    out: dict = {name: "" if name in _TEXT else 0 for name in FIELDS} | {"extra": {}, "status": STATUS[0]}
    for number, value in _fields(data):
        name = _NAMES.get(number)
        if name == "extra":
            entry = dict(_fields(value))
            out["extra"][entry.get(1, b"").decode()] = entry.get(2, b"").decode()
        elif name in _TEXT:
            out[name] = value.decode()
        elif name == "status":
            out[name] = STATUS[value]
        elif name:
            value = value - (1 << 64) if value >> 63 else value
            out[name] = value
    return out


@F.pandas_udf(T.BinaryType())
def _pack(rows: pd.DataFrame) -> pd.Series:
    return pd.Series([pack({k: None if v is None or v is pd.NA or v != v else v for k, v in r.items()}) for r in rows.to_dict("records")], dtype=object)


@F.pandas_udf(PAYLOAD)
def from_bytes(data: pd.Series) -> pd.DataFrame:
    """Messages from their binary form; what can't be read is null throughout."""

    def one(x):
        try:
            return unpack(bytes(x))
        except (TypeError, ValueError, IndexError):
            return dict.fromkeys(FIELDS)

    return pd.DataFrame([one(x) for x in data], columns=list(PAYLOAD.names)).astype(object)


def to_bytes(message: Column | None = None) -> Column:
    """The binary form of a struct, or of the row's own columns."""
    return _pack(message if message is not None else F.struct(*FIELDS))
