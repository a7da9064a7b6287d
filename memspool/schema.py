"""Schemas of the engine's tables.  Readers always take these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "TIMESTAMP": T.TimestampType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()), "MAP<STRING,STRING>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(ddl: str) -> T.StructType:
    """A schema without a session, which a DDL parser would need."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


PARTS = ("identity", "episodes", "threads")
GRANULARITIES = ("summary", "episode", "detail")
CONFIDENCES = ("stated", "inferred")
FORMAT_VERSION = "1.0"

TURN_JSON = _struct("role STRING, content STRING, timestamp STRING, conversation_id STRING, turn_id STRING")
TURNS = _struct("src_ord BIGINT, conv_id STRING, turn_id STRING, role STRING, content STRING, ts STRING")
NODE_JSON = _struct(
    "id STRING, text STRING, granularity STRING, salience DOUBLE, confidence STRING, created_at TIMESTAMP, last_confirmed_at TIMESTAMP, "
    "superseded_by STRING, parent_id STRING, valid_from STRING, valid_until STRING, quote STRING, source_refs ARRAY<STRING>, tags ARRAY<STRING>"
)
NODE_FIELDS = NODE_JSON.fieldNames()
NODES = T.StructType([*_struct("part STRING, ord BIGINT").fields, *NODE_JSON.fields])
QUESTIONS = _struct("question STRING, expected ARRAY<STRING>, category STRING")
PAIRS = _struct("part STRING, chunk BIGINT, kind STRING, pair_ord BIGINT, i BIGINT, j BIGINT")
LEDGER = _struct("conv_id STRING, digest STRING")
MANIFEST = _struct(
    "format_version STRING, created_at TIMESTAMP, updated_at TIMESTAMP, source_models ARRAY<STRING>, generator STRING, "
    "content_hashes MAP<STRING,STRING>, extracted MAP<STRING,STRING>"
)


def absent(c: Column) -> Column:
    """True for null and for the empty string."""
    return F.coalesce(c, F.lit("")) == ""


def present(c: Column) -> Column:
    """The value, with the empty string made null."""
    return F.nullif(c, F.lit(""))


def with_node_defaults(nodes: DataFrame, now: Column) -> DataFrame:
    """Fill the optional fields of nodes as the format defines them."""
    empty = F.array().cast("array<string>")
    fill = {
        "granularity": F.coalesce("granularity", F.lit("episode")),
        "salience": F.coalesce("salience", F.lit(0.5)),
        "confidence": F.coalesce("confidence", F.lit("stated")),
        "created_at": F.coalesce("created_at", now),
        "last_confirmed_at": F.coalesce("last_confirmed_at", now),
        "source_refs": F.coalesce("source_refs", empty),
        "tags": F.coalesce("tags", empty),
    }
    return nodes.withColumns(fill)


def node_errors(nodes: DataFrame) -> DataFrame:
    """``id, error`` of nodes whose values are out of their ranges."""
    checks = F.array_compact(
        F.array(
            F.when(F.col("text").isNull(), "text is missing"),
            F.when(~F.col("salience").between(0.0, 1.0), "salience is outside 0 to 1"),
            F.when(~F.col("granularity").isin(*GRANULARITIES), "unknown granularity"),
            F.when(~F.col("confidence").isin(*CONFIDENCES), "unknown confidence"),
        )
    )
    return nodes.select("id", F.explode(checks).alias("error"))
