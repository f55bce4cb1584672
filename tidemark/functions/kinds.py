"""What sort of column is this? One rule for all operators, from the schema only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOATING = (T.FloatType, T.DoubleType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.BooleanType)):
        return "text"
    if isinstance(data_type, DATETIME):
        return "datetime"
    return "other"


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "numeric")


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "text")


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "datetime")


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    if isinstance(df.schema[name].dataType, FLOATING):
        return ref(name).isNull() | F.isnan(ref(name))
    return ref(name).isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value with NaN turned into NULL."""
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.when(~F.isnan(ref(name)), ref(name))
    return ref(name)


def number(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def kind_column(df: DataFrame, column: str = "column_name") -> Column:
    """CASE expression from column name to kind."""
    lookup = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, kind_of(f.dataType))])
    return lookup[F.col(column)]


DISPLAY = {
    "float": "Float 64", "double": "Float 64",
    "tinyint": "Int 64", "smallint": "Int 64", "int": "Int 64", "bigint": "Int 64",
    "string": "Object",
    "timestamp": "DateTime", "timestamp_ntz": "DateTime", "date": "DateTime",
}


def display_type(data_type: T.DataType) -> str:
    return DISPLAY.get(data_type.simpleString(), data_type.simpleString().title())
