"""Captured stream frames and realtime events as tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger.functions import jsontext as J
from gateledger.functions.principals import valid_call_id
from gateledger.operators.ordered import BLOCK_ROWS, halo_blocks, running_sum

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

LINE_CAP = 1024 * 1024
PENDING_CAP = 4 * 1024 * 1024

FINISH_REASONS = (
    "stop", "length", "tool_calls", "content_filter", "function_call", "end_turn",
    "max_tokens", "stop_sequence", "pause_turn", "tool_use",
)
ROLES = ("system", "user", "assistant", "tool", "function", "developer")
OBJECT_KINDS = (
    "chat.completion.chunk", "chat.completion", "text_completion", "text_completion.chunk",
    "embedding", "list",
)
STRUCTURAL = {
    "event": ("object",),
    "choice": ("finish_reason", "index", "object"),
    "delta": (
        "role", "index", "id", "type", "function_call_id", "tool_call_id", "stop", "object",
        "finish_reason",
    ),
}
MAX_DEPTH = 64

TOOL_CALL_EVENT = "response.function_call_arguments.done"
AUDIO_EVENTS = ("response.audio.delta", "input_audio_buffer.append")
TEXT_EVENTS = ("response.text.delta", "response.audio_transcript.delta")

# --------------------------------------------------------------------------


def assemble_frames(frames: DataFrame) -> DataFrame:
    """Frames (request_id, frame_idx, text) → events (request_id, event_idx, …).

    A blank line ends an event, however the frames cut the text.  Frames are
    split on their own; only the piece around each frame border is put back
    together, and pieces are grouped by the event they belong to.  No response
    is collected as a whole: the biggest group is one event, and events longer
    than the pending cap become malformed rows without text.
    """
    # Empty frames say nothing and must not stand between two that belong together.
    held = frames.where(F.length("text") > 0).withColumn("_one", F.lit(1))
    frames = running_sum(held, ["request_id"], "frame_idx", F.col("_one"), "_place").withColumn(
        "frame_idx", F.col("_place") - 1
    ).drop("_one", "_place")
    lines_ended = F.regexp_replace("text", "\r\n|\r", "\n")
    # A frame may end inside CRLF or inside the blank line: look one back.
    blocks = halo_blocks(frames.withColumn("_t", lines_ended), "frame_idx", 1, BLOCK_ROWS)
    order = Window.partitionBy("request_id", "_block").orderBy("frame_idx")
    previous = F.lag("text").over(order)
    fixed = (
        blocks.withColumn("_prev", previous)
        .where("not _context")
        .withColumn("_t", F.when(F.endswith(F.col("_prev"), F.lit("\r"))
                                 & F.startswith(F.col("text"), F.lit("\n")),
                                 F.substr(F.col("_t"), F.lit(2))).otherwise(F.col("_t")))
    )
    # Character-level line feeds decide event ends: a feed that follows one.
    open_feed = F.endswith(F.regexp_replace("_prev", "\r\n|\r", "\n"), F.lit("\n"))
    marked = fixed.withColumn(
        "_m",
        F.when(open_feed & F.startswith(F.col("_t"), F.lit("\n")),
               F.concat(F.lit("\n"), F.col("_t"))).otherwise(F.col("_t")),
    )
    pieces = marked.withColumn("_parts", F.split("_m", "\n\n+", -1)).withColumn(
        "_ends", F.size("_parts") - 1
    )
    numbered = running_sum(pieces, ["request_id"], "frame_idx", F.col("_ends"), "_upto")
    exploded = numbered.select(
        "request_id", "frame_idx", (F.col("_upto") - F.col("_ends")).alias("_first"),
        F.posexplode("_parts").alias("_i", "_piece"),
    ).withColumn("_event", F.col("_first") + F.col("_i"))
    # An event may never end; such text is counted, not collected.
    pieces_only = exploded.where("_piece <> ''")
    endless = (
        pieces_only.groupBy("request_id", "_event")
        .agg(F.sum(F.length("_piece")).alias("_chars"))
        .where(F.col("_chars") > PENDING_CAP)
        .select("request_id", "_event")
    )
    whole = (
        pieces_only.join(endless, ["request_id", "_event"], "left_anti")
        .groupBy("request_id", "_event")
        .agg(F.array_sort(F.collect_list(F.struct("frame_idx", "_i", "_piece"))).alias("_ps"))
        .withColumn("_text", F.array_join(F.transform("_ps", lambda p: p["_piece"]), ""))
    )
    data_lines = F.filter(F.split("_text", "\n"), lambda x: F.startswith(x, F.lit("data:")))
    data = F.array_join(
        F.transform(data_lines, lambda x: F.regexp_replace(F.substr(x, F.lit(6)), "^ ", "")), "\n"
    )
    too_long = F.exists(F.split("_text", "\n"), lambda x: F.length(x) > LINE_CAP)
    events = whole.where(F.size(data_lines) > 0).select(
        "request_id", F.col("_event").alias("event_idx"), data.alias("data"),
        too_long.alias("oversize"),
    ).where("data <> '[DONE]'")
    document = J.strict_json(F.col("data"))
    malformed = F.col("oversize") | document.isNull() | (J.variant_kind(document) != "OBJECT")
    refused = endless.select(
        "request_id", F.col("_event").alias("event_idx"), F.lit(None).cast("string").alias("data"),
        F.lit(True).alias("malformed"),
    )
    return events.withColumn("malformed", malformed).drop("oversize").unionByName(refused)


def delta_text(data: Column) -> Column:
    """Plain ``delta.content`` (or completion ``text``) of the first choice."""
    return F.coalesce(
        F.get_json_object(data, "$.choices[0].delta.content"),
        F.get_json_object(data, "$.choices[0].text"),
    )


class _Abort(Exception):
    pass


def _structural(key: str, value: object, level: str) -> bool:
    """True when a structural member may be skipped; raises on a bad value."""
    if value is None:
        return key != "role"
    if key == "index":
        if isinstance(value, bool):
            raise _Abort(f"bad {level}.{key}")
        if isinstance(value, int):
            return True
        if level != "delta" or not isinstance(value, str):
            return False
    kinds = None if level == "delta" else OBJECT_KINDS
    allowed = {"role": ROLES, "finish_reason": FINISH_REASONS, "object": kinds}.get(key)
    if isinstance(value, str):
        fine = value in allowed if allowed else (
            bool(value) and value.isascii() and value.isprintable()
        )
        if not fine:
            raise _Abort(f"bad {level}.{key}")
        return True
    return allowed is None and isinstance(value, (int, float)) and not isinstance(value, bool)


def _strings(node: object, level: str | None, depth: int, skip: tuple[str, ...] = ()):
    if depth > MAX_DEPTH:
        raise _Abort("too deep")
    members = node.items() if isinstance(node, dict) else ((None, v) for v in node)
    for key, value in members:
        if key in skip:
            continue
        if level and key in STRUCTURAL[level] and _structural(key, value, level):
            continue
        if isinstance(value, str):
            yield value
        elif isinstance(value, (dict, list)):
            yield from _strings(value, None, depth + 1)


def event_strings(event: dict) -> list[str]:
    """Every string of an event but valid structural values, walked by level."""
    found = list(_strings(event, "event", 0, ("choices",)))
    choices = event.get("choices")
    if isinstance(choices, list):
        for choice in choices:
            if isinstance(choice, dict):
                found += _strings(choice, "choice", 0, ("delta",))
                delta = choice.get("delta")
                if isinstance(delta, dict):
                    found += _strings(delta, "delta", 0)
                elif isinstance(delta, str):
                    found.append(delta)
            elif isinstance(choice, str):
                found.append(choice)
    elif isinstance(choices, (dict, str)):
        found += _strings([choices], None, 0)
    return found


_WALK = T.StructType(
    [
        T.StructField("strings", T.ArrayType(T.StringType())),
        T.StructField("abort", T.StringType()),
    ]
)


def collect_event_strings(events: DataFrame, data: str = "data") -> DataFrame:
    """Add ``strings`` and ``abort``; plain one-delta events stay native."""
    simple = F.col(data).rlike(
        r'^\{"choices":\[\{"delta":\{"content":"[^"\\]*"\}(,"index":\d+)?\}\]\}$'
    )
    abort, walk_strings, loads = _Abort, event_strings, json.loads

    @F.pandas_udf(_WALK)
    def walk(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if text is None:
                rows.append((None, None))
                continue
            try:
                document = loads(text)
                rows.append((walk_strings(document) if isinstance(document, dict) else [], None))
            except abort as exc:
                rows.append(([], str(exc)))
            except (ValueError, RecursionError):
                rows.append(([], "malformed"))
        return pd.DataFrame(rows, columns=["strings", "abort"])

    walked = events.withColumn("_w", walk(F.when(~simple, F.col(data))))
    quick = F.array(F.get_json_object(data, "$.choices[0].delta.content"))
    return walked.withColumn(
        "strings", F.when(simple, quick).otherwise(F.col("_w.strings"))
    ).withColumn("abort", F.col("_w.abort")).drop("_w")


def realtime_route(event_type: Column) -> Column:
    """tool_call, audio, text or pass."""
    return (
        F.when(event_type == TOOL_CALL_EVENT, "tool_call")
        .when(event_type.isin(*AUDIO_EVENTS), "audio")
        .when(event_type.isin(*TEXT_EVENTS), "text")
        .otherwise("pass")
    )


def route_realtime_events(events: DataFrame, data: str = "data") -> dict[str, DataFrame]:
    """Split events by route; each part reads the same scan with its filter."""
    routed = events.withColumn("route", realtime_route(F.get_json_object(data, "$.type")))
    return {r: routed.where(F.col("route") == r) for r in ("tool_call", "audio", "text", "pass")}


def extract_tool_calls(events: DataFrame, data: str = "data") -> DataFrame:
    """tool_name (default ``<unknown>``) and object-shaped arguments."""
    document = F.try_parse_json(data)
    arguments = F.try_variant_get(document, "$.arguments", "variant")
    kind = J.variant_kind(arguments)
    text = F.when(kind == "STRING", arguments.cast("string"))
    inner = J.strict_json(text)
    wrapped = F.concat(F.lit('{"_raw":'), F.to_json(inner), F.lit("}"))
    raw_text = F.to_json(F.create_map(F.lit("_raw"), text))
    shaped = (
        F.when(kind == "OBJECT", F.to_json(arguments))
        .when(J.variant_kind(inner) == "OBJECT", F.to_json(inner))
        .when(inner.isNotNull(), wrapped)
        .when(kind == "STRING", raw_text)
        .otherwise("{}")
    )
    call_id = F.get_json_object(data, "$.call_id")
    return events.select(
        *events.columns,
        F.coalesce(F.nullif(F.get_json_object(data, "$.name"), F.lit("")), F.lit("<unknown>")).alias("tool_name"),
        F.when(valid_call_id(call_id), call_id).alias("call_id"),
        shaped.alias("arguments"),
    )
