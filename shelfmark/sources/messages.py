"""Object-created messages as object keys, and the messages that cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OBJECT = T.StructType([T.StructField("object", T.StructType([T.StructField("key", T.StringType())]))])
_BODY = T.StructType(
    [
        T.StructField("detail", _OBJECT),
        T.StructField("Records", T.ArrayType(T.StructType([T.StructField("s3", _OBJECT)]))),
    ]
)


def _body(body: Column) -> Column:
    return F.from_json(body, _BODY, {"mode": "PERMISSIVE"})


def is_malformed(body: Column) -> Column:
    return F.get_json_object(body, "$").isNull()


def unquote_key(key: Column) -> Column:
    """Percent escapes and plus signs undone; a broken escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(key), F.replace(key, F.lit("+"), F.lit(" ")))


def parse_object_events(messages: DataFrame, body: str = "body") -> DataFrame:
    """Messages exploded to object ``key``s. Both shapes are read, also when one
    message has both: ``detail.object.key`` and ``Records[].s3.object.key``."""
    keep = [c for c in messages.columns if c != body]
    parsed = messages.where(~is_malformed(F.col(body))).withColumn("_b", _body(F.col(body)))
    listed = F.transform(
        F.coalesce("_b.Records", F.array().cast(_BODY["Records"].dataType)),
        lambda r: r["s3"]["object"]["key"],
    )
    found = F.filter(
        F.concat(F.array("_b.detail.object.key"), listed), lambda k: F.coalesce(k != "", F.lit(False))
    )
    return parsed.select(*keep, F.explode(found).alias("key")).withColumn(
        "key", unquote_key(F.col("key"))
    )


def malformed_messages(messages: DataFrame, body: str = "body") -> DataFrame:
    """Messages whose body is not JSON, for the quarantine table."""
    return messages.where(is_malformed(F.col(body))).withColumn("error", F.lit("malformed"))
