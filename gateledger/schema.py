"""Table schemas and the fixed values that decide results."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# They must equal the published behaviour for results to match.
# ---------------------------------------------------------------------------

DECISIONS = ("allow", "block", "redact", "escalate")
OWNER_TYPES = ("human", "agent", "policy", "unresolved")
STAGES = ("admission", "inspection", "commitment", "record")
SEVERITIES = ("high", "medium", "low")
BREAK_KINDS = (
    "self_mismatch",
    "link_mismatch",
    "unknown_key",
    "missing_key_id",
    "merkle_mismatch",
    "archive_missing",
    "archive_format_invalid",
    "malformed_line",
    "cascade_suppressed",
)

LEVEL_NAMES = ("UNCLASS", "CUI", "SECRET", "TS", "TS_SCI")
LEVEL_ALIASES = {
    "UNCLASS": 0,
    "UNCLASSIFIED": 0,
    "U": 0,
    "CUI": 1,
    "FOUO": 1,
    "SECRET": 2,
    "S": 2,
    "TS": 3,
    "TOP SECRET": 3,
    "TOPSECRET": 3,
    "TS/SCI": 4,
    "TS-SCI": 4,
    "TS_SCI": 4,
    "SCI": 4,
}

RISK_TIERS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

OUTPUT_MARKERS = {
    "SECRET//NOFORN": 2,
    "SECRET//REL": 2,
    "TOP SECRET//SCI": 4,
    "TS//SCI": 4,
    "(S)": 2,
    "(S//NF)": 2,
    "(TS)": 3,
    "(TS//SCI)": 4,
    "(C)": 1,
    "(U)": 0,
    "(U//FOUO)": 1,
    "(SECRET)": 2,
    "(TOP SECRET)": 3,
    "(CONFIDENTIAL)": 1,
    "CUI//": 1,
    "FOUO": 1,
    "//NOFORN": 2,
    "//FVEY": 2,
    "//ORCON": 2,
    "//IMCON": 2,
}

WINDOW_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}

MAX_TS_NS = 10**19
MAX_PRINCIPAL_CHARS = 256
MAX_SESSION_ID_BYTES = 256
MAX_JSON_DEPTH = 64
MAX_BODY_BYTES = 4 * 1024 * 1024
ACCUMULATED_TEXT_CHARS = 1024 * 1024

KEY_ID_FIELD = "_signing_key_id"
ANCHOR_FIELD = "_anchor"
MARKER_CHECK = "_compaction"
MARKER_FIELD = "_compaction_marker"
MARKER_SIGNATURE_FIELD = "_marker_signature"
ARCHIVE_VERSION = 1

LATENCY_BUCKETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)

GATED_PATHS = (
    "/v1/chat/completions",
    "/v1/completions",
    "/v1/embeddings",
    "/v1/realtime",
)

UNSAFE_EFFECT_WORDS = ("destroy", "delete", "irreversible", "payment", "transfer")

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

ENTRY_FIELDS = [
    ("entry_id", T.StringType()),
    ("ts_ns", T.DecimalType(20, 0)),
    ("owner_type", T.StringType()),
    ("owner_id", T.StringType()),
    ("approval_chain", T.ArrayType(T.StringType())),
    ("check_name", T.StringType()),
    ("decision", T.StringType()),
    ("reason", T.StringType()),
    ("request_fingerprint", T.StringType()),
    ("metadata", T.StringType()),
    ("prev_hmac", T.StringType()),
    ("hmac", T.StringType()),
]

DECISION_SCHEMA = T.StructType(
    [T.StructField("chain_id", T.StringType()), T.StructField("seq", T.LongType())]
    + [T.StructField(name, kind) for name, kind in ENTRY_FIELDS]
    + [T.StructField("raw_line", T.StringType())]
)

BREAK_SCHEMA = T.StructType(
    [
        T.StructField("chain_id", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("entry_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)

CHECK_RESULT = T.StructType(
    [
        T.StructField("decision", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("replacement", T.StringType()),
    ]
)
