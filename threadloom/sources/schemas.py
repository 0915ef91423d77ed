"""Row types of the archive's tables and the fixed domains of its enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

_text = T.StringType()
_long = T.LongType()
_longs = T.ArrayType(_long)


def _struct(required: tuple[str, ...], **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, name not in required) for name, kind in fields.items()])


#: Upstream payload, without its two tolerant booleans, which arrive in many shapes and are decoded apart.
PAYLOAD = T.StructType([T.StructField(n, k) for n, k in (("id", _long), ("type", _text), ("by", _text), ("time", _long), ("text", _text), ("parent", _long), ("poll", _long), ("url", _text), ("score", _long), ("title", _text), ("parts", _longs), ("descendants", _long), ("kids", _longs))])

ITEMS = _struct(("id",), id=_long, deleted=T.BooleanType(), type=_text, by=_text, time=_long, text=_text, dead=T.BooleanType(), parent=_long, poll=_long, url=_text, score=_long, title=_text, parts=_longs, descendants=_long, domain=_text, day=T.DateType(), story_id=_long)
KIDS = _struct(("item", "kid"), item=_long, kid=_long, display_order=_long)
USERS = _struct(("id",), id=_text, created=_long, karma=_long, about=_text, submitted=_text)
SEGMENTS = _struct(("segment_id", "start_id", "end_id", "status", "attempts", "unresolved_count"), segment_id=_long, start_id=_long, end_id=_long, status=_text, attempts=T.IntegerType(), scan_cursor_id=_long, unresolved_count=T.IntegerType(), last_error=_text, failure_class=_text)
EXCEPTIONS = _struct(("segment_id", "item_id", "state", "attempts"), segment_id=_long, item_id=_long, state=_text, attempts=T.IntegerType(), last_error=_text, failure_class=_text)
UPDATES = _struct((), path=_text, data=_struct((), items=_longs, profiles=T.ArrayType(_text)))

# The state machine's domains.
SEGMENT_STATUSES = ("pending", "in_progress", "done", "retry_wait", "dead_letter")
EXCEPTION_STATES = ("pending", "retry_wait", "terminal_missing", "dead_letter")
FAILURE_CLASSES = ("network_transient", "http_4xx", "decode", "schema")
