"""Readers for the four raw tables: CSV as the reference loads them, or parquet.

Every read carries the explicit schema of ``schemas.py``; nothing is inferred
(inference is an extra pass over the files and unstable across files).  CSV is
read as text and typed by expressions, so that a line that can't be taken has
a reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import raw_schemas

TABLES = ("experts", "funnel_events", "engagements", "daily_channel_spend")

# text is kept byte for byte: staging, not the loader, trims and lower-cases
CSV_OPTIONS = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# quotes inside a quoted field are doubled, as warehouses export JSON text; an
# empty quoted field is an empty text and an empty bare one is NULL
QUOTING = {"quote": '"', "escape": '"'}
NO_VALUE = {"nullValue": "\0", "emptyValue": ""}


class RawTables:
    """The four source tables of the funnel.

    Give the DataFrames, or a ``loader(name)`` that builds one on first use,
    so a report that needs one table never plans the others.
    """

    def __init__(
        self,
        experts: DataFrame | None = None,
        funnel_events: DataFrame | None = None,
        engagements: DataFrame | None = None,
        daily_channel_spend: DataFrame | None = None,
        loader: Callable[[str], DataFrame] | None = None,
    ):
        self._frames = {
            "experts": experts,
            "funnel_events": funnel_events,
            "engagements": engagements,
            "daily_channel_spend": daily_channel_spend,
        }
        self._loader = loader

    def _get(self, name: str) -> DataFrame:
        if self._frames[name] is None:
            if self._loader is None:
                raise ValueError(f"raw table {name!r} not given")
            self._frames[name] = self._loader(name)
        return self._frames[name]

    @property
    def experts(self) -> DataFrame:
        return self._get("experts")

    @property
    def funnel_events(self) -> DataFrame:
        return self._get("funnel_events")

    @property
    def engagements(self) -> DataFrame:
        return self._get("engagements")

    @property
    def daily_channel_spend(self) -> DataFrame:
        return self._get("daily_channel_spend")

    def table(self, name: str) -> DataFrame:
        return self._get(name)

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: self._get(name) for name in TABLES}


_LINE = "_line"


def _typed(column, kind: T.DataType):
    """A text field as ``kind``, NULL where it is none; a time may carry a zone
    (``UTC``, ``Z``, ``+02:00``) and is the UTC clock time."""
    if isinstance(kind, T.StringType):
        return column
    text = F.trim(column)
    if isinstance(kind, T.TimestampNTZType):
        return text.try_cast("timestamp").cast("timestamp_ntz")
    if isinstance(kind, T.DateType):
        # an export may write a date as a midnight time
        return F.coalesce(text.try_cast("date"), F.to_date(text.try_cast("timestamp")))
    return text.try_cast(kind)


def _csv_lines(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    """Every line of a CSV table: its fields as text and as their types, the
    line itself, and ``_reason`` where it can't be taken."""
    names = [f.name for f in schema]
    text = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(_LINE, T.StringType())])
    read = (
        spark.read.schema(text)
        .options(**CSV_OPTIONS, **QUOTING, **NO_VALUE)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _LINE)
        .option("multiLine", str(multi_line).lower())
        .csv(path)
    )
    typed = {f.name: _typed(F.col(f.name), f.dataType) for f in schema}
    # a type's own message beats that of an unfit number of fields
    wrong = [
        F.when(F.col(f.name).isNotNull() & (F.trim(f.name) != "") & typed[f.name].isNull(), F.concat(F.lit(f"{f.name} is no {f.dataType.simpleString()}: "), F.col(f.name)))
        for f in schema if not isinstance(f.dataType, T.StringType)
    ]
    missing = [F.when(F.col(f.name).isNull(), F.lit(f"{f.name} is missing")) for f in schema if not f.nullable]
    shape = F.when(F.col(_LINE).isNotNull(), F.lit(f"not a line of {len(names)} fields"))
    return read.select(
        *[c.alias(n) for n, c in typed.items()],
        F.coalesce(F.col(_LINE), F.concat_ws(",", *names)).alias(_LINE),
        F.coalesce(shape, *wrong, *missing).alias("_reason"),
    )


def read_csv_tables(
    spark: SparkSession, base_dir: str, key_type: str = "bigint", rejects: str = "fail", multi_line: bool = False
) -> RawTables:
    """Read ``{base_dir}/{table}.csv`` (header row) with the declared schemas.

    Fields may be quoted, with doubled quotes inside; times may end in a zone.
    ``key_type``: type of the keys, e.g. ``string``.  ``rejects``: ``fail`` ends
    the read at a line with a wrong number of fields, a value that isn't of its
    type, or no key, as a warehouse load would; ``skip`` leaves such lines out
    (``rejected_lines`` gives them).  ``multi_line``: fields may hold line
    breaks, for which each file is read by one task.
    """
    if rejects not in ("fail", "skip"):
        raise ValueError(f"rejects is fail or skip, not {rejects!r}")
    frames = {}
    for name, schema in raw_schemas(key_type).items():
        lines = _csv_lines(spark, f"{base_dir}/{name}.csv", schema, multi_line)
        if rejects == "fail":
            error = F.raise_error(F.concat(F.lit(f"{name}.csv: "), "_reason")).cast("boolean")
            good = F.when(F.col("_reason").isNotNull(), error).otherwise(F.lit(True))
        else:
            good = F.col("_reason").isNull()
        frames[name] = lines.where(good).select(*[f.name for f in schema])
    return RawTables(**frames)


def rejected_lines(spark: SparkSession, base_dir: str, key_type: str = "bigint", multi_line: bool = False) -> DataFrame:
    """(table_name, line, reason) of every line that ``read_csv_tables`` can't take."""
    found = None
    for name, schema in raw_schemas(key_type).items():
        bad = _csv_lines(spark, f"{base_dir}/{name}.csv", schema, multi_line).where(F.col("_reason").isNotNull())
        rows = bad.select(F.lit(name).alias("table_name"), F.col(_LINE).alias("line"), F.col("_reason").alias("reason"))
        found = rows if found is None else found.unionByName(rows)
    return found


def read_parquet_tables(spark: SparkSession, base_dir: str, key_type: str = "bigint") -> RawTables:
    """Read ``{base_dir}/{table}`` parquet datasets written by ``write_raw``."""
    frames = {
        name: spark.read.schema(schema).parquet(f"{base_dir}/{name}") for name, schema in raw_schemas(key_type).items()
    }
    return RawTables(**frames)


def write_raw(tables: RawTables, base_dir: str, fmt: str = "parquet") -> None:
    """Write the four raw tables (full overwrite), e.g. to freeze a fixture."""
    for name, df in tables.as_dict().items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.options(**CSV_OPTIONS, **QUOTING).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(
                f"{base_dir}/{name}.csv"
            )
        else:
            writer.parquet(f"{base_dir}/{name}")
