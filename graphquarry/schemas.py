"""Table schemas and the closed vocabularies of the graph."""

from __future__ import annotations

from pyspark.sql import types as T

# Entity kinds, edge kinds and the subsets that queries depend on.
ENTITY_KINDS = (
    "Module", "File", "Function", "Struct", "Trait", "Impl", "Class", "Service",
    "Person", "Team", "Test", "Document", "Deployment",
)
EDGE_KINDS = (
    "imports", "calls", "inherits", "implements", "exposes", "depends_on",
    "co_changes_with", "broke_after", "deployed_to", "reverted_because", "owned_by",
    "reviewed_by", "documented_in", "decided_because", "failed_when",
)
STRUCTURAL_KINDS = ("imports", "calls", "inherits", "implements", "exposes", "depends_on")
HOTSPOT_KINDS = ("File", "Module", "Function", "Struct", "Trait", "Impl", "Class", "Service")
REPORT_LINK_KINDS = ("imports", "depends_on")

# The evidence columns every edge carries.
EVIDENCE_COUNT = 1
DECAY_HALF_LIFE = 180.0

# What a request gets that does not say.
DEFAULT_DEPTH = 3
DEFAULT_LIMIT = 20
COCHANGE_REPORT_THRESHOLD = 0.25

ENTITY = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("path", T.StringType(), True),
    T.StructField("language", T.StringType(), True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("last_indexed", T.TimestampType(), True),
])

EDGE = T.StructType([
    T.StructField("from_id", T.StringType(), False),
    T.StructField("to_id", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("confidence", T.DoubleType(), True),
    T.StructField("last_evidence", T.TimestampType(), True),
    T.StructField("evidence_count", T.IntegerType(), True),
    T.StructField("decay_half_life", T.DoubleType(), True),
    T.StructField("evidence", T.ArrayType(T.StringType()), True),
])

REQUEST = T.StructType([
    T.StructField("request_id", T.StringType(), True),
    T.StructField("tool", T.StringType(), True),
    T.StructField("entity", T.StringType(), True),
    T.StructField("depth", T.LongType(), True),
    T.StructField("direction", T.StringType(), True),
    T.StructField("limit", T.LongType(), True),
])
