"""Values as JSON-safe and report-safe text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_timestamp(c: Column) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    zone = F.lit("+00:00")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
                    zone)


def json_safe(c: Column, dtype: T.DataType) -> Column:
    """Decimals and ids to text, dates to ISO, bytes to hex, floats to text.

    A column has one type, so all floats become text where one may be nan or infinite.
    """
    if isinstance(dtype, T.DecimalType):
        return c.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return float_safe(c)
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = iso_timestamp(c)
        return F.replace(text, F.lit("+00:00"), F.lit("")) \
            if isinstance(dtype, T.TimestampNTZType) else text
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: json_safe(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda k, v: json_safe(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[
            json_safe(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    return c


def json_safe_rows(df: DataFrame) -> DataFrame:
    return df.select(*[json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
                       for f in df.schema.fields])


def row_json(df: DataFrame) -> Column:
    """One JSON object per row; floats JSON cannot hold become text."""
    cells = []
    for f in df.schema.fields:
        cell = json_safe(F.col(f"`{f.name}`"), f.dataType)
        cells.append(cell.alias(f.name))
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def float_safe(c: Column) -> Column:
    """A finite float as it is, others as the text nan, inf or -inf."""
    return (F.when(F.isnan(c), F.lit("nan"))
            .when(c == float("inf"), F.lit("inf"))
            .when(c == float("-inf"), F.lit("-inf"))
            .otherwise(c.cast("string")))


def sorted_map_json(c: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def report_text(c: Column, dtype: T.DataType) -> Column:
    """Null to '', booleans to true/false, maps to JSON with sorted keys."""
    if isinstance(dtype, T.MapType):
        text = sorted_map_json(c)
    elif isinstance(dtype, (T.StructType, T.ArrayType)):
        text = F.to_json(c)
    elif isinstance(dtype, T.TimestampType):
        text = iso_timestamp(c)
    else:
        text = json_safe(c, dtype).cast("string")
    return F.coalesce(text, F.lit(""))


def formula_safe(c: Column) -> Column:
    """A leading quote where a spreadsheet would read the text as a formula."""
    start = F.regexp_replace(c, r"^(?U)[\s\x1c-\x1f]+", "")
    risky = start.rlike(r"^[=+\-@]") & ~start.rlike(r"^[+-]?\d+(?:\.\d+)?$")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def excel_cell(c: Column) -> Column:
    """Longest text a spreadsheet cell holds."""
    return F.substring(c, 1, 32767)


def merge_metadata(*maps: Column) -> Column:
    """Later keys win (session setting LAST_WIN is not needed: keys are filtered)."""
    merged = maps[0]
    for later in maps[1:]:
        merged = F.map_concat(_without(merged, later), later)
    return merged


def _without(kept: Column, later: Column) -> Column:
    return F.map_filter(kept, lambda k, v: ~F.map_contains_key(later, k))
