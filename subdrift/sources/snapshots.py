"""Reading and normalising snapshots of the configuration and the catalogue."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subdrift.schemas import CAPTURE_SCHEMA, INPUT_TABLES, SERVER


def read_table(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    **options,
) -> DataFrame:
    """Read one snapshot table.

    ``fmt`` is any Spark source: parquet, orc, json, csv, or jdbc (no path; pass
    ``url``, ``dbtable`` and, for a parallel read, ``partitionColumn`` and its
    bounds as options; a live table must go through ``Snapshot.stored`` first, as one plan
    reads a table more than once and has to find the same rows). CSV is read with a header and without type inference.
    Give a ``schema`` where the server names in partition folders look like numbers,
    or Spark reads ``server=007`` as 7.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    reader = reader.options(**options)
    return reader.load(path) if path is not None else reader.load()


def normalise(
    table: str,
    df: DataFrame,
    server: str | Column | None = None,
    capture_schema: str | Column | None = None,
    unique: bool = False,
    servers: tuple[str, ...] | None = None,
) -> DataFrame:
    """Bring a raw snapshot into the library's shape.

    Picks the needed columns by name in any letter case, removes trailing blanks
    (the source compares ``'A'`` equal to ``'A  '``, Spark does not), adds the scope
    columns where the snapshot lacks them, and drops repeated rows unless ``unique``
    says there are none. Copies are combined before they are shuffled, so a row copied
    very often costs no more than any other in the joins that follow; a single
    catalogue export has primary keys and can save that shuffle. ``servers`` keeps the rows
    of those servers only, by a condition that reaches the scan.
    """
    spec = INPUT_TABLES[table]
    present = {c.lower(): c for c in df.columns}
    given = {SERVER: server, CAPTURE_SCHEMA: capture_schema}

    missing = [c for c in spec.scope if c not in present and given[c] is None]
    selected = [
        _as_text(df[present[c]] if given[c] is None else _as_column(given[c])).alias(c)
        for c in spec.scope
        if c not in missing
    ]
    for source_name, name in spec.columns.items():
        alternatives = [source_name] + [a for a, t in spec.aliases.items() if t == name]
        found = next((present[a] for a in alternatives if a in present), None)
        if found is not None:
            selected.append(_as_text(df[found]).alias(name))
        elif source_name in spec.optional:
            selected.append(F.lit(None).cast(T.StringType()).alias(name))
        else:
            missing.append(source_name)
    if missing:
        raise ValueError(f"snapshot table {table!r} lacks the columns {missing}; it has {df.columns}")
    if servers is not None:
        if given[SERVER] is None:
            df = df.where(_raw_is_one_of(df, present[SERVER], servers))
        clean = df.select(selected).where(F.col(SERVER).isin(*servers))
    else:
        clean = df.select(selected)
    return clean if unique or not spec.drop_copies else clean.distinct()


def _raw_is_one_of(df: DataFrame, name: str, values: tuple[str, ...]) -> Column:
    """What follows for a raw text from its being one of ``values`` up to trailing blanks.

    Unlike a comparison of the trimmed text it can be pushed into a scan: a value with
    blanks behind it lies between the value and the value with ``!``, the character
    after the blank.
    """
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.lit(True)
    ranges = [(df[name] >= v) & (df[name] < v + "!") for v in values]
    return reduce(lambda a, b: a | b, ranges, F.lit(False))


def _as_column(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _as_text(column: Column) -> Column:
    return F.rtrim(column.cast(T.StringType()))


@dataclass(frozen=True)
class Snapshot:
    """The normalised inputs of one run, over one server or many."""

    subs: DataFrame
    sendqueues: DataFrame
    src_cols: DataFrame
    tables: DataFrame
    columns: DataFrame
    q_base: DataFrame | None = None
    # The raw tables and how they were normalised, for conditions that must reach their scans.
    origin: tuple[dict[str, DataFrame], dict] | None = field(default=None, repr=False, compare=False)

    @classmethod
    def of(
        cls,
        raw: dict[str, DataFrame],
        server=None,
        capture_schema=None,
        unique: bool = False,
        servers: tuple[str, ...] | None = None,
    ) -> Snapshot:
        """Normalise a dict of raw tables; ``q_base`` may be left out."""
        how = {"server": server, "capture_schema": capture_schema, "unique": unique, "servers": servers}
        return cls(**{name: normalise(name, df, **how) for name, df in raw.items()}, origin=(raw, how))

    @classmethod
    def load(
        cls,
        spark: SparkSession,
        base_path: str,
        fmt: str = "parquet",
        server=None,
        capture_schema=None,
        unique: bool = False,
        tables: tuple[str, ...] = tuple(INPUT_TABLES),
        schemas: dict[str, T.StructType | str] | None = None,
        servers: tuple[str, ...] | None = None,
        **options,
    ) -> Snapshot:
        """Load ``{base_path}/{table}`` for every table. With ``servers``, scans skip the others
        where the files allow it (partition folders, row groups)."""
        schemas = schemas or {}
        raw = {
            t: read_table(spark, f"{base_path}/{t}", fmt, schemas.get(t), **options) for t in tables
        }
        return cls.of(raw, server, capture_schema, unique, servers)

    def stored(self, path: str) -> Snapshot:
        """Write the normalised tables under ``path`` and go on from the files.

        For several reports over one large snapshot: each table is cleaned once. Files
        are cut by ranges of server and key, so a run over one server skips the others
        and a very large server still fills many files.
        """
        stored = {}
        for name, df in self._tables().items():
            df.repartitionByRange(*df.columns).write.parquet(f"{path}/{name}")
            stored[name] = df.sparkSession.read.parquet(f"{path}/{name}")
        return Snapshot(**stored)

    def for_server(self, server: str) -> Snapshot:
        """The part of a fleet snapshot that belongs to one server; the condition reaches the scans."""
        if self.origin is not None:
            raw, how = self.origin
            if how["servers"] is None:
                return Snapshot.of(raw, **how | {"servers": (server,)})
        return Snapshot(
            **{name: df.where(F.col(SERVER) == server) for name, df in self._tables().items()}
        )

    def with_copies(self, name: str) -> DataFrame:
        """A table without the dropping of repeated rows, for a use that combines them anyway."""
        if self.origin is None:
            return getattr(self, name)
        raw, how = self.origin
        return normalise(name, raw[name], **how | {"unique": True})

    def unflagged_tables(self) -> DataFrame:
        """Tables whose capture flag is set to something other than 'Y'."""
        exact = F.col("data_capture") != "Y"
        if self.origin is not None:
            raw, how = self.origin
            df = raw["tables"]
            name = next(c for c in df.columns if c.lower() in ("data_capture", "datacapture"))
            if isinstance(df.schema[name].dataType, T.StringType):
                # Follows from the exact test and, unlike it, reaches the scan.
                return normalise("tables", df.where(df[name] != "Y"), **how).where(exact)
        return self.tables.where(exact)

    def _tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in INPUT_TABLES if getattr(self, name) is not None}
