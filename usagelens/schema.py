"""Column roles of a session table.

Every operator takes ``(df, schema)``.  A :class:`SessionSchema` says which
column is the user, which is the duration, which columns belong to which
application and so on, so the same operators run on any session layout.
Columns a table lacks are skipped where a skip makes sense; the helpers here
resolve that once, when the plan is built, from ``df.columns``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, types as T


@dataclass(frozen=True)
class Application:
    """One application with its downlink and uplink volume columns."""

    key: str
    title: str

    @property
    def downlink(self) -> str:
        return f"{self.key}_dl"

    @property
    def uplink(self) -> str:
        return f"{self.key}_ul"

    @property
    def columns(self) -> tuple[str, str]:
        return (self.downlink, self.uplink)

    @property
    def total(self) -> str:
        return f"{self.key}_total_bytes"


# The applications a session record is split into.
APPLICATIONS = (
    Application("social_media", "Social Media"),
    Application("google", "Google"),
    Application("email", "Email"),
    Application("youtube", "YouTube"),
    Application("netflix", "Netflix"),
    Application("gaming", "Gaming"),
    Application("other", "Other"),
)


@dataclass(frozen=True)
class QualityMetric:
    """A downlink/uplink pair that is averaged per user into one metric."""

    downlink: str
    uplink: str
    downlink_mean: str
    uplink_mean: str
    combined: str


# Names of the per-user service quality metrics.
QUALITY_METRICS = (
    QualityMetric("tcp_dl_bytes", "tcp_ul_bytes",
                  "avg_tcp_dl_retrans", "avg_tcp_ul_retrans", "avg_tcp_retransmission"),
    QualityMetric("rtt_dl_ms", "rtt_ul_ms",
                  "avg_rtt_dl_ms", "avg_rtt_ul_ms", "avg_rtt_ms"),
    QualityMetric("tp_dl_kbps", "tp_ul_kbps",
                  "avg_throughput_dl_kbps", "avg_throughput_ul_kbps", "avg_throughput_kbps"),
)

ENGAGEMENT_METRICS = ("sessions_frequency", "total_duration_ms", "total_traffic_bytes")
EXPERIENCE_METRICS = tuple(m.combined for m in QUALITY_METRICS)

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
            T.FloatType, T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class SessionSchema:
    """Roles of the columns of a session table (names after normalisation)."""

    user: str = "user_id"
    duration: str = "dur_ms"
    order: str = "start_ts"
    manufacturer: str = "handset_manufacturer"
    handset: str = "handset_type"
    total_downlink: str = "total_dl"
    total_uplink: str = "total_ul"
    total: str = "total_data"
    ids: tuple[str, ...] = ("bearer_id", "imsi", "user_id", "imei", "start_ms", "end_ms")
    applications: tuple[Application, ...] = APPLICATIONS
    quality: tuple[QualityMetric, ...] = QUALITY_METRICS
    renames: Mapping[str, str] = field(default_factory=dict)

    # -- resolution against a concrete table ---------------------------------

    def numeric(self, df: DataFrame, skip_ids: bool = False) -> list[str]:
        """Numeric columns in table order, with or without the id-like ones."""
        return [f.name for f in df.schema.fields
                if isinstance(f.dataType, _NUMERIC)
                and not (skip_ids and f.name in self.ids)]

    @staticmethod
    def integral(df: DataFrame) -> list[str]:
        """Whole-number columns, counting decimals of scale zero."""
        return [f.name for f in df.schema.fields
                if isinstance(f.dataType, _INTEGRAL)
                or (isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0)]

    @staticmethod
    def categorical(df: DataFrame) -> list[str]:
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]

    def app_columns(self, df: DataFrame) -> list[str]:
        """All application volume columns that exist, downlink before uplink."""
        return [c for a in self.applications for c in a.columns if c in df.columns]

    def present_apps(self, df: DataFrame) -> list[tuple[Application, list[str]]]:
        """Applications with at least one volume column, with those columns."""
        found = [(a, [c for c in a.columns if c in df.columns]) for a in self.applications]
        return [(a, cols) for a, cols in found if cols]


# Raw header of the telecom session file -> column name used here.
TELECOM_HEADER = {
    "Bearer Id": "bearer_id",
    "Start": "start_ts",
    "Start ms": "start_ms",
    "End": "end_ts",
    "End ms": "end_ms",
    "Dur. (ms)": "dur_ms",
    "IMSI": "imsi",
    "MSISDN/Number": "user_id",
    "IMEI": "imei",
    "Handset Manufacturer": "handset_manufacturer",
    "Handset Type": "handset_type",
    "Avg RTT DL (ms)": "rtt_dl_ms",
    "Avg RTT UL (ms)": "rtt_ul_ms",
    "Avg Bearer TP DL (kbps)": "tp_dl_kbps",
    "Avg Bearer TP UL (kbps)": "tp_ul_kbps",
    "TCP DL Retrans. Vol (Bytes)": "tcp_dl_bytes",
    "TCP UL Retrans. Vol (Bytes)": "tcp_ul_bytes",
    "Total DL (Bytes)": "total_dl",
    "Total UL (Bytes)": "total_ul",
    "Total Data (Bytes)": "total_data",
} | {
    f"{raw} {way.upper()} (Bytes)": f"{key}_{way}"
    for raw, key in (("Social Media", "social_media"), ("Google", "google"),
                     ("Email", "email"), ("Youtube", "youtube"), ("Netflix", "netflix"),
                     ("Gaming", "gaming"), ("Other", "other"))
    for way in ("dl", "ul")
}

DEFAULT = SessionSchema()
TELECOM = SessionSchema(renames=TELECOM_HEADER)


def snake_case(name: str) -> str:
    """A column name free of dots, blanks, brackets and slashes."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def normalise_names(df: DataFrame, schema: SessionSchema = TELECOM) -> DataFrame:
    """Strip the header and map every column to a plain snake_case name."""
    stripped = [c.strip() for c in df.columns]
    return df.toDF(*[schema.renames.get(c, snake_case(c)) for c in stripped])


def require(df: DataFrame, columns: Sequence[str], what: str) -> None:
    """Fail early, while the plan is built, if a needed column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{what}: missing column(s) {', '.join(missing)}")
