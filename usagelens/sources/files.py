"""Session files and the feature store."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import astuple, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from usagelens.operators.cleaning import (LEARNED, CleaningModel, clean, fit_cleaning,
                                          typed_sessions)
from usagelens.schema import DEFAULT, TELECOM, SessionSchema, normalise_names, snake_case
from usagelens.workspace import COMPRESSION, passing_shuffles

_FLOATING = (T.FloatType, T.DoubleType)

# Column types of a raw telecom session file by role; anything else is a double.
_TEXT = ("handset_manufacturer", "handset_type")
_WHOLE = ("bearer_id", "imsi", "user_id", "imei")
#: Mark of a malformed line among rejected cells.
LINE = "_line"
#: Rows of one packed CSV file.
CSV_ROWS = 500_000
#: Folder and columns of the log of a stored table's versions.
LOG, ENTRY = "log", "number long, version string, fingerprint string, rows long"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are null; Spark aggregates would count NaN as a value."""
    return df.select(*[
        F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, _FLOATING) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def _cell(c: str):
    """A text cell as the type its role asks for; null where it does not fit."""
    if c in _TEXT:
        return F.col(c)
    if c in ("start_ts", "end_ts"):
        return F.expr(f"try_cast(`{c}` AS TIMESTAMP)")
    wanted = "DECIMAL(20,0)" if c in _WHOLE else "DOUBLE"
    # identifiers are often written in floating notation
    return F.expr(f"try_cast(try_cast(`{c}` AS DECIMAL(38,10)) AS {wanted})"
                  if c in _WHOLE else f"try_cast(`{c}` AS {wanted})")


def _typed(df: DataFrame, rejected: str | None = None, line: str | None = None) -> DataFrame:
    """Text cells of a CSV file as the types their role asks for; bad cells are null.

    ``rejected`` names a column that lists, per row, the columns whose cell says something that
    does not fit, and ``LINE`` if the line as a whole had too many or too few cells.
    """
    cells = [c for c in df.columns if c != line]
    out = [_cell(c).alias(c) for c in cells]
    if rejected:
        def refused(c: str):
            said = F.trim(F.col(c))  # looked at only where the cell, which is needed anyway, is null
            return F.when(_cell(c).isNull() & (said != "") & (F.lower(said) != "nan"), F.lit(c))
        marks = [F.when(F.col(line).isNotNull(), F.lit(LINE)), *[refused(c) for c in cells]]
        out.append(F.array_compact(F.array(*marks)).alias(rejected))
    return df.select(*out)


def _csv_with_lines(spark: SparkSession, path: str, schema: SessionSchema, options: dict) -> DataFrame:
    """All cells as text under plain names, and malformed lines whole in a column ``LINE``."""
    header = spark.read.options(header=True, **options).csv(path).columns  # one line is read
    names = [schema.renames.get(c.strip(), snake_case(c)) for c in header]
    struct = T.StructType([T.StructField(n, T.StringType()) for n in [*names, LINE]])
    return spark.read.schema(struct).options(**{
        "header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE, **options}).csv(path)


def read_sessions(spark: SparkSession, path: str, file_format: str = "parquet",
                  schema: SessionSchema = TELECOM, struct: T.StructType | None = None,
                  rejected: str | None = None, **options) -> DataFrame:
    """Raw sessions with plain column names and nulls for missing values.

    CSV files are read as text and typed by column role, so no inference pass over the data
    is needed; ``struct`` overrides that with declared types.  ``rejected`` adds a column of that
    name with the cells of a CSV row that did not fit their type.
    """
    by_role = file_format == "csv" and struct is None
    if rejected and not by_role:
        raise ValueError("only cells of CSV files that are typed by role can be rejected")
    if rejected:
        return nan_to_null(_typed(_csv_with_lines(spark, path, schema, options), rejected, LINE))
    reader = spark.read.options(**({"header": True} if file_format == "csv" else {}), **options)
    if struct is not None:
        reader = reader.schema(struct)
    named = normalise_names(reader.format(file_format).load(path), schema)
    return nan_to_null(_typed(named) if by_role else named)


def rejection_counts(df: DataFrame, rejected: str) -> DataFrame:
    """``variable, rows``: how many rows had a cell of each column rejected."""
    return df.select(F.explode(rejected).alias("variable")).groupBy("variable").agg(
        F.count("*").alias("rows"))


def raw_header(df: DataFrame, schema: SessionSchema = TELECOM, pad: str = "") -> DataFrame:
    """The names that session files have in place of the plain ones, between ``pad``."""
    raw = {plain: name for name, plain in schema.renames.items()}
    return df.toDF(*[f"{pad}{raw.get(c, c)}{pad}" for c in df.columns])


def write_sessions_csv(df: DataFrame, path: str) -> None:
    """Sessions as CSV files packed by gzip, blanks kept.

    Such a file cannot be split among readers, so it gets a bounded number of rows.
    """
    with passing_shuffles(df.sparkSession):
        df.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                         maxRecordsPerFile=CSV_ROWS, compression="gzip",
                         **{"zlib.compress.level": "BEST_SPEED"}).csv(path)


def read_field_descriptions(spark: SparkSession, path: str,
                            file_format: str = "csv") -> DataFrame:
    """The dictionary of columns that comes with the session file."""
    df = spark.read.options(header=True).format(file_format).load(path)
    return df.toDF(*[c.strip() for c in df.columns])


def save_feature(df: DataFrame, path: str) -> None:
    """Replace a feature table."""
    with passing_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(path, compression=COMPRESSION)


def load_feature(spark: SparkSession, path: str) -> DataFrame:
    """Read a feature table; a missing one is a ``FileNotFoundError``."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no feature table at {path}") from e
        raise


# -- stored tables that know their source --------------------------------------

def input_fingerprint(spark: SparkSession, inputs: Sequence[str], settings: Mapping | None = None) -> str:
    """Digest of the files below the input paths (name, size, time of change) and of settings.

    Only listings are read.  Hidden files do not count; a path that is not there is an error.
    """
    found = []
    for path in inputs:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            raise FileNotFoundError(f"no input at {path}")
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    told = json.dumps([sorted(found), sorted((settings or {}).items())], default=str)
    return hashlib.sha256(told.encode()).hexdigest()


@dataclass(frozen=True)
class Manifest:
    """One version of a table: its number, its folder, and what it was made of."""

    number: int
    version: str
    fingerprint: str
    rows: int

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Manifest | None:
        """The latest entry of the table's log."""
        try:
            row = spark.read.schema(ENTRY).json(f"{path}/{LOG}").orderBy(F.desc("number")).first()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return row and cls(*row)

    def publish(self, spark: SparkSession, path: str) -> None:
        """Add the entry to the log: one file, seen by readers as a whole or not at all."""
        spark.createDataFrame([astuple(self)], ENTRY).coalesce(1) \
             .write.mode("append").json(f"{path}/{LOG}")


class StoredTable:
    """A table below ``path`` in versions, rebuilt when what it was made of changes.

    A version is written whole before the log names it, so a failed build leaves the table as it
    was.  The version before the current one stays for readers that still use it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def current(self, fingerprint: str | None = None) -> DataFrame | None:
        """The table, if there is one that was made of this input."""
        held = Manifest.read(self.spark, self.path)
        if held is None or fingerprint not in (None, held.fingerprint):
            return None
        return self.spark.read.parquet(f"{self.path}/{held.version}")

    def fingerprints(self) -> set[str]:
        """What all versions so far were made of."""
        if Manifest.read(self.spark, self.path) is None:
            return set()
        rows = self.spark.read.schema(ENTRY).json(f"{self.path}/{LOG}").select("fingerprint").collect()
        return {r.fingerprint for r in rows}

    def replace(self, table: DataFrame, fingerprint: str) -> DataFrame:
        before = Manifest.read(self.spark, self.path)
        version = f"version-{uuid.uuid4().hex}"
        with passing_shuffles(self.spark):
            table.write.parquet(f"{self.path}/{version}", compression=COMPRESSION)
        written = self.spark.read.parquet(f"{self.path}/{version}")
        Manifest(before.number + 1 if before else 1, version, fingerprint,
                 written.count()).publish(self.spark, self.path)
        self._drop_all_but(version, before and before.version)
        return written

    def _drop_all_but(self, *kept: str | None) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(place):
            name = status.getPath().getName()
            if name.startswith("version-") and name not in kept:
                fs.delete(status.getPath(), True)

    def load_or_create(self, fingerprint: str, make: Callable[[], DataFrame],
                       force_reload: bool = False) -> DataFrame:
        held = None if force_reload else self.current(fingerprint)
        return self.replace(make(), fingerprint) if held is None else held


def load_or_create_cleaned(spark: SparkSession, path: str, sessions: Callable[[], DataFrame],
                           force_reload: bool = False, inputs: Sequence[str] = (),
                           keep: str = "rows", **cleaning) -> DataFrame:
    """The stored cleaned table, or clean ``sessions()``, store and return it.

    With ``inputs``, the paths that the sessions are read from, a table made of other files or
    with other settings is not used but replaced.

    ``keep="model"`` stores what the cleaning learned in place of the rows: the table is then the
    projection of ``sessions()`` by it, the same rows without a second copy of them.  It is for
    sessions that are already stored and come out equal at every call.
    """
    if keep not in ("rows", "model"):
        raise ValueError(f"unknown form of a stored table {keep!r}")
    fingerprint = input_fingerprint(spark, inputs, cleaning)
    stored = StoredTable(spark, path)
    if keep == "rows":
        return stored.load_or_create(fingerprint, lambda: clean(sessions(), **cleaning), force_reload)
    schema = cleaning.get("schema", DEFAULT)
    typed = typed_sessions(sessions(), schema)
    learned = stored.load_or_create(fingerprint, lambda: spark.createDataFrame(
        fit_cleaning(typed, **cleaning).rows(), LEARNED).coalesce(1), force_reload)
    return CleaningModel.from_rows(learned.collect(), schema).transform(typed)
