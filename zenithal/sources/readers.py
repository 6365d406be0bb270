"""Readers for ingest: CSV dialects, Parquet with chosen and optional columns, rows; and the types of schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError

# Schema types by their first word, without length and sign.
_TYPES = {
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "mediumint": T.IntegerType(), "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "real": T.DoubleType(), "bit": T.BooleanType(), "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "char": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "tinytext": T.StringType(), "mediumtext": T.StringType(), "longtext": T.StringType(), "enum": T.StringType(), "set": T.StringType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "blob": T.BinaryType(), "tinyblob": T.BinaryType(), "mediumblob": T.BinaryType(), "longblob": T.BinaryType(),
    "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(), "time": T.StringType(), "year": T.ShortType(),
}


def spark_type(sql: str) -> T.DataType:
    """Spark's type for a type of an ingest schema."""
    low = sql.strip().lower()
    m = re.match(r"([a-z]+)\s*(?:\(([^)]*)\))?", low)
    if m and m[1] in ("decimal", "numeric"):
        p, _, s = (m[2] or "10,0").partition(",")
        return T.DecimalType(int(p), int(s or 0))
    if not m or m[1] not in _TYPES:
        raise AnalysisError(f"unknown type {sql!r}")
    if "unsigned" in low:
        return {"tinyint": T.ShortType(), "smallint": T.IntegerType(), "mediumint": T.IntegerType(), "int": T.LongType(), "integer": T.LongType(), "bigint": T.DecimalType(20, 0)}.get(m[1], _TYPES[m[1]])
    if m[1] == "bit" and m[2] not in (None, "1"):
        return T.LongType()
    return _TYPES[m[1]]


def schema(columns: list[dict]) -> T.StructType:
    """Schema from a list of {name, type}."""
    return T.StructType([T.StructField(c["name"], spark_type(c["type"]), "not null" not in c["type"].lower()) for c in columns])


@dataclass(frozen=True)
class CsvDialect:
    """How fields are parted, quoted and escaped."""

    delimiter: str = "\t"
    quote: str | None = None
    escape: str = "\\"
    null: str = "\\N"
    encoding: str = "UTF-8"
    header: bool = False


def read_csv(spark: SparkSession, path: str | list[str], columns: T.StructType, dialect: CsvDialect | None = None) -> DataFrame:
    """Rows of CSV files; a field that does not fit its type fails the read."""
    d = dialect or CsvDialect()
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.BooleanType, T.BinaryType)) else f.dataType) for f in columns])
    reader = spark.read.schema(text).option("sep", d.delimiter).option("nullValue", d.null).option("emptyValue", "").option("encoding", d.encoding).option("header", d.header).option("mode", "FAILFAST").option("escape", d.escape)
    raw = reader.option("quote", d.quote or "").csv(path)
    made = []
    for f in columns:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = c.isin("1", "\x01", "true")
        made.append(c.cast(f.dataType).alias(f.name))
    return raw.select(*made)


def write_csv(df: DataFrame, path: str, dialect: CsvDialect | None = None) -> None:
    """CSV files of a table, one for each partition."""
    d = dialect or CsvDialect(",", '"')
    df.write.mode("overwrite").option("sep", d.delimiter).option("quote", d.quote or "").option("escape", d.escape).option("nullValue", d.null).option("header", d.header).csv(path)


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, optional: dict[str, str] | None = None) -> DataFrame:
    """Chosen columns of Parquet files in their order; optional ones that a file lacks are null of the given type."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    have = {c.lower(): c for c in df.columns}
    out = []
    for name in columns or df.columns:
        if name.lower() in have:
            out.append(F.col(f"`{have[name.lower()]}`").alias(name))
        elif optional and name in optional:
            out.append(F.lit(None).cast(spark_type(optional[name])).alias(name))
        else:
            raise AnalysisError(f"the files have no column {name}")
    return df.select(*out)


def parquet_to_csv(spark: SparkSession, source: str, target: str, columns: list[str] | None = None, optional: dict[str, str] | None = None, dialect: CsvDialect | None = None) -> None:
    """Parquet files as CSV files."""
    write_csv(read_parquet(spark, source, columns, optional), target, dialect)


def from_rows(spark: SparkSession, rows: list[list], columns: T.StructType) -> DataFrame:
    """Rows of values (as JSON has them) by a schema; strings become what the schema says."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in columns])
    said = [[None if v is None else str(int(v)) if isinstance(v, bool) else str(v) for v in row] for row in rows]
    return spark.createDataFrame(said, text).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in columns])
