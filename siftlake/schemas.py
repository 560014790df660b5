"""Schemas of the platform's tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_PLAIN = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType()}


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("map<"):
        key, _, value = text[4:-1].partition(",")
        return T.MapType(_PLAIN[key], _type(value))
    return _PLAIN[text]


def _struct(text: str) -> T.StructType:
    """Columns as `name type, ...`; needs no session, so that modules can be read anywhere."""
    return T.StructType([T.StructField(name, _type(kind)) for name, kind in (part.split(" ") for part in text.split(", "))])


SITES = _struct(
    "id int, api_key string, protocol string, domain string, path string, user_id bigint, status string, rate_limit int, validation_token string, "
    "validation_token_expires_at timestamp, validation_method string, validation_status string, created_at timestamp, updated_at timestamp, "
    "expires_at timestamp, verified_at timestamp, jwt_ttl int, model string, chunk_size int, chunk_overlap int, indexing_node_type string, "
    "indexing_node string, estimated_pages int, average_page_size int, st_dev_page_size int, max_search_results int"
)
INDEX_NODES = _struct("id int, node_name string, node_type string, sentinel_name string, max_capacity_bytes bigint, used_memory_bytes bigint, assigned_memory_bytes bigint, status string, created_at timestamp, updated_at timestamp")
INDEX_REQUESTS = _struct("id int, site_id int, requested_memory_bytes bigint, status string, assigned_node_id int, assigned_at timestamp, created_at timestamp, updated_at timestamp")
DEAD_LETTERS = _struct("id int, site_id int, doc_id int, subject string, error_message string, payload_json string, retry_count int, status string, created_at timestamp, updated_at timestamp, reprocessed_at timestamp")
PAYLOAD = _struct("site_id int, id int, text string, extra map<string,string>, timestamp_millis bigint, retry_count int, max_retries int, status string, error_message string, last_retry_timestamp bigint, language string")
DLQ_MESSAGE = _struct("timestamp bigint, site_id int, doc_id int, subject string, error_message string, retry_count int, payload_json string, payload_proto string")
CHUNK = _struct("site_id int, post_id int, offset int, text string, dense array<float>, sparse map<bigint,float>, point_id bigint")
REQUEST_LOG = _struct("timestamp timestamp, method string, url string, headers map<string,array<string>>, remote_addr string, body string")
EVENT = _struct("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
