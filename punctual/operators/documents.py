"""Statistics of a day or week as one nested document, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType


def _list(section: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """key, name: the section's rows of each key as an array, in order."""
    rest = [x for x in section.columns if x != key and x not in order]
    return section.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))


def documents(key: str, one: dict[str, DataFrame], many: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """key, document (JSON text) of each key of any section.

    one: sections of a row a key, which become objects. many: sections of several rows a key, which become arrays in the order of the named columns;
    a key's rows are one cell, so sections are statistics (a row a route, hour or bucket), not observations. A section without rows is null (one) or
    left out (many). Null values are kept.
    """
    parts = [(name, df.select(key, F.struct(*[x for x in df.columns if x != key]).alias(name))) for name, df in one.items()]
    parts += [(name, _list(df, key, name, order)) for name, (df, order) in many.items()]
    out = None
    for _, df in parts:
        out = df if out is None else out.join(df, key, "full")
    body = F.to_json(F.struct(F.col(key), *[name for name, _ in parts]), {"ignoreNullFields": "false"})
    return out.select(key, body.alias("document"))


def document_schema(key: str, one: dict[str, DataFrame], many: dict[str, tuple[DataFrame, list[str]]]) -> StructType:
    """The schema by which parsed() reads documents of these sections again."""
    rest = lambda df: [f for f in df.schema.fields if f.name != key]
    fields = [next(f for f in next(iter([*one.values(), *[df for df, _ in many.values()]])).schema.fields if f.name == key)]
    fields += [StructField(name, StructType(rest(df))) for name, df in one.items()]
    fields += [StructField(name, ArrayType(StructType(rest(df)))) for name, (df, _) in many.items()]
    return StructType(fields)


def parsed(docs: DataFrame, schema: StructType) -> DataFrame:
    """The sections of documents as columns; a document that is not of this form is an error."""
    return docs.select(F.from_json("document", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def section(parsed_docs: DataFrame, key: str, name: str) -> DataFrame:
    """One section as flat rows again: the columns of the table that it was made of."""
    if isinstance(parsed_docs.schema[name].dataType, ArrayType):
        return parsed_docs.select(key, F.inline(name))
    return parsed_docs.where(F.col(name).isNotNull()).select(key, f"{name}.*")


def week_grid(daily: DataFrame, week_start: str, values: list[str]) -> DataFrame:
    """week_start, route_id, days: seven structs of values from Sunday on, null for days that are missing. daily: service_date, route_id, values."""
    own = daily.withColumn("week_start", F.date_sub("service_date", F.dayofweek("service_date") - 1)).where(F.col("week_start") == F.lit(week_start).cast("date"))
    by_day = own.groupBy("week_start", "route_id").agg(F.map_from_entries(F.collect_list(F.struct(F.dayofweek("service_date"), F.struct(*values)))).alias("_by_day"))
    return by_day.select("week_start", "route_id", F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.try_element_at("_by_day", k)).alias("days"))
