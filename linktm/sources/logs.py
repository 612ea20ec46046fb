"""Log documents: one JSON document per line, as text, by a declared schema, or schemaless as typed values."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linktm.scratch import materialize

# What a value of a schemaless document is, by the first word of its type.
KINDS = {"OBJECT": "object", "ARRAY": "array", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number",
         "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def log_documents(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Documents below `path` as text in `document`, and parsed into `doc` when a
    schema is given (null for a line that is not JSON). A missing path is empty."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    documents = lines.select(F.col("value").alias("document"))
    if schema is None:
        return documents
    return documents.withColumn("doc", F.from_json("document", schema))


def document_field(document: Column | str, json_path: str) -> Column:
    """One field of a schemaless document, as text."""
    return F.get_json_object(document, json_path)


def typed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents below `path` as text in `document` and as a typed value of any form, VARIANT, in `doc`: null for a
    line that is not JSON or repeats a key within an object. A missing path is empty."""
    return log_documents(spark, path).withColumn("doc", F.try_parse_json("document"))


def typed_field(doc: Column | str, json_path: str, type_name: str) -> Column:
    """One field of a typed document; null where it is missing or does not fit the type."""
    return F.try_variant_get(doc, json_path, type_name)


def merged_schema(documents: DataFrame, column: str = "doc") -> DataFrame:
    """`merged`: the one type that holds all documents, fields of any document included."""
    return documents.agg(F.schema_of_variant_agg(column).alias("merged"))


def document_paths(documents: DataFrame, column: str = "doc") -> DataFrame:
    """`path`, `kind`, `n`: every path of all documents, what its values are and how many there are. The elements
    of an array share the path `[*]`; keys with other signs than letters, digits and _ are quoted. One pass per level of
    nesting over the objects and arrays of that level; null documents have no path."""
    spark = documents.sparkSession
    level = documents.select(F.lit("$").alias("path"), F.col(column).alias("value")).where(F.col("value").isNotNull())
    names = F.create_map(*[F.lit(text) for pair in KINDS.items() for text in pair])
    first_word = F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z]+", 0)
    found: DataFrame | None = None
    while True:
        kind = F.coalesce(names[first_word], F.lower(first_word))
        values = level.select("path", kind.alias("kind"), "value")
        inner = F.when(F.col("kind").isin("object", "array"), F.col("value"))
        kinds = materialize(values.withColumn("value", inner), "paths")
        counts = kinds.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
        found = counts if found is None else found.unionByName(counts)
        nested = kinds.where(F.col("value").isNotNull())
        if nested.isEmpty():
            return found
        parts = nested.withColumnRenamed("value", "whole").lateralJoin(
            spark.tvf.variant_explode(F.col("whole").outer())
        )
        quoted = F.concat(F.lit("['"), F.replace("key", F.lit("'"), F.lit("\\'")), F.lit("']"))
        named = F.when(F.col("key").rlike(r"^\w+$"), F.concat(F.lit("."), "key")).otherwise(quoted)
        step = F.when(F.col("kind") == "array", "[*]").otherwise(named)
        level = parts.select(F.concat("path", step).alias("path"), "value")
