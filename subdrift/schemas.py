"""Schemas of the inputs and outputs.

The configuration and catalogue tables arrive as snapshots of many servers.
``columns`` lists what a snapshot must carry under its source name and the
name used inside the library; the owner/name pair of a source table has one
name everywhere, so joins are plain ``USING`` joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SERVER = "server"
CAPTURE_SCHEMA = "capture_schema"


@dataclass(frozen=True)
class InputTable:
    name: str
    columns: dict[str, str]
    scope: tuple[str, ...]
    aliases: dict[str, str]
    optional: tuple[str, ...] = ()
    # False where every use groups by key anyway, so dropping copies on load would
    # only add a shuffle.
    drop_copies: bool = True


def _table(name, columns, scope, aliases=None, optional=(), drop_copies=True):
    return InputTable(name, columns, scope, aliases or {}, tuple(optional), drop_copies)


_CONFIG_SCOPE = (SERVER, CAPTURE_SCHEMA)
_CATALOG_SCOPE = (SERVER,)

SUBS = _table(
    "subs",
    {
        "subname": "subname",
        "source_owner": "source_owner",
        "source_name": "source_name",
        "target_owner": "target_owner",
        "target_name": "target_name",
        "state": "state",
        "sendq": "sendq",
        "target_server": "target_server",
    },
    _CONFIG_SCOPE,
    optional=("target_owner", "target_name"),
)
SENDQUEUES = _table(
    "sendqueues", {"sendq": "sendq", "pubqmapname": "pubqmapname"}, _CONFIG_SCOPE
)
SRC_COLS = _table(
    "src_cols", {"subname": "subname", "src_colname": "column_name"}, _CONFIG_SCOPE
)
# The capture flag has one name on the distributed platform and another on the host.
TABLES = _table(
    "tables",
    {"creator": "source_owner", "name": "source_name", "data_capture": "data_capture"},
    _CATALOG_SCOPE,
    aliases={"datacapture": "data_capture"},
    drop_copies=False,
)
COLUMNS = _table(
    "columns",
    {"tbcreator": "source_owner", "tbname": "source_name", "name": "column_name"},
    _CATALOG_SCOPE,
)
Q_BASE = _table(
    "q_base",
    {
        "tabschema": "source_owner",
        "tabname": "source_name",
        "target_schema": "target_owner",
        "target_name": "target_name",
        "targetcolclause": "targetcolclause",
    },
    _CONFIG_SCOPE,
)

INPUT_TABLES = {t.name: t for t in (SUBS, SENDQUEUES, SRC_COLS, TABLES, COLUMNS, Q_BASE)}


def _string(name):
    return T.StructField(name, T.StringType())


FINDINGS = T.StructType(
    [T.StructField("ordercol", T.IntegerType(), False)]
    + [
        _string(n)
        for n in (
            "program",
            "current_server",
            "mtyp",
            "subname",
            "sev",
            "mtxt",
            "fixit",
            "target_server",
            "state",
            "source_owner",
            "source_name",
            "tbcreator",
            "tbname",
            "colname",
        )
    ]
)


@dataclass(frozen=True)
class ParmTable:
    """One threshold table: its display name, column defaults, shipped row and comments."""

    name: str
    defaults: dict[str, int]
    shipped: dict[str, int]
    comments: dict[str, dict[str, str]]

    @property
    def schema(self) -> T.StructType:
        return self.schema_in("EN")

    def schema_in(self, lang: str) -> T.StructType:
        """The columns with their comments in one of the report languages."""
        return T.StructType(
            [
                T.StructField(c, T.IntegerType(), False, {"comment": self.comments[lang][c], "default": d})
                for c, d in self.defaults.items()
            ]
        )


# Parameter names, defaults and the row delivered with them.
PARM_APPLY = ParmTable(
    name="QREP_MON_APPLY_PARM",
    defaults={
        "alat_thresh_warning": 30,
        "alat_thresh_error": 600,
        "alat_cause_cap_qdepth": 100,
        "alat_cause_app_qdepth": 60000,
        "exception_time_window": 24,
        "heartbeat_time_window": 10,
        "maxdepth_global": 100000,
    },
    shipped={
        "alat_thresh_warning": 600,
        "alat_thresh_error": 3600,
        "alat_cause_cap_qdepth": 100,
        "alat_cause_app_qdepth": 60000,
        "exception_time_window": 24,
        "heartbeat_time_window": 10,
        "maxdepth_global": 130000,
    },
    comments={
        "EN": {
            "alat_thresh_warning": "end-to-end latency in seconds above which a sample is a WARNING",
            "alat_thresh_error": "end-to-end latency in seconds above which a sample is an ERROR",
            "alat_cause_cap_qdepth": "queue depth up to which a late sample is put down to CAPTURE",
            "alat_cause_app_qdepth": "queue depth from which a late sample is put down to APPLY",
            "exception_time_window": "how many hours back exceptions are listed",
            "heartbeat_time_window": "how many minutes back heartbeats are counted",
            "maxdepth_global": "carried along, no behaviour yet",
        },
        "DE": {
            "alat_thresh_warning": "Latenz in Sekunden, ab deren Ueberschreitung WARNING gemeldet wird",
            "alat_thresh_error": "Latenz in Sekunden, ab deren Ueberschreitung ERROR gemeldet wird",
            "alat_cause_cap_qdepth": "bis zu dieser Queue-Tiefe gilt CAPTURE als Ursache",
            "alat_cause_app_qdepth": "ab dieser Queue-Tiefe gilt APPLY als Ursache",
            "exception_time_window": "so viele Stunden zurueck werden Ausnahmen gelistet",
            "heartbeat_time_window": "so viele Minuten zurueck werden Heartbeats gezaehlt",
            "maxdepth_global": "wird mitgefuehrt, noch ohne Wirkung",
        },
    },
)
PARM_CAPTURE = ParmTable(
    name="QREP_MON_CAPTURE_PARM",
    defaults={"clat_thresh_warning": 300, "clat_thresh_error": 3600, "maxdepth_global": 100000},
    shipped={"clat_thresh_warning": 500, "clat_thresh_error": 5400, "maxdepth_global": 130000},
    comments={
        "EN": {
            "clat_thresh_warning": "capture latency in seconds above which a sample is a WARNING",
            "clat_thresh_error": "capture latency in seconds above which a sample is an ERROR",
            "maxdepth_global": "carried along, no behaviour yet",
        },
        "DE": {
            "clat_thresh_warning": "Latenz in Sekunden, ab deren Ueberschreitung WARNING gemeldet wird",
            "clat_thresh_error": "Latenz in Sekunden, ab deren Ueberschreitung ERROR gemeldet wird",
            "maxdepth_global": "wird mitgefuehrt, noch ohne Wirkung",
        },
    },
)
