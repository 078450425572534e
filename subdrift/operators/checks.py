"""The four drift checks.

Each takes a normalised ``Snapshot`` and returns findings. Existence tests are
semi and anti joins on server-prefixed keys, columns are compared as sets of names; message
texts are built last, from narrow rows, so only findings pay for them. ``table_drift`` and
``column_drift`` answer two checks in one pass over the inputs, for runs that want all of them.

Skew: subscriptions of hot source tables and hot queues are salted. Tables with
very many columns and subscriptions with very many columns meet in joins with a
plain shuffle on both sides, which the adaptive skew join splits on either side.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subdrift.functions import clauses, texts
from subdrift.operators.skew import SALT, add_salt, copy_per_salt, hot_keys
from subdrift.schemas import CAPTURE_SCHEMA, FINDINGS, SERVER
from subdrift.sources import Snapshot

# Codes and order of the checks.
ORDER = {"C-TNF": 110, "C-CNF": 120, "C-CNS": 130, "C-DCC": 140}
DEBUG_WIDTH = 18

_SUBSCRIPTION = [SERVER, CAPTURE_SCHEMA, "subname"]
TABLE_KEYS = _TABLE = [SERVER, "source_owner", "source_name"]
_QUEUE = [SERVER, CAPTURE_SCHEMA, "sendq"]
_TARGET = ["target_owner", "target_name"]
_INTENT = [*_TABLE, CAPTURE_SCHEMA, *_TARGET]
_QUEUE_SALT = "_queue_salt"


@dataclass(frozen=True)
class Options:
    """Report language, delimiter of the add-column signal, generator mode of
    C-CNS, its debug prefix, and the row count from which a key counts as hot (by default
    a share of the data, see ``skew``). ``packed`` compares columns as one set per table and
    per subscription, which databases bound to some thousand names; without it
    every column is a row of its own, for inputs of any width."""

    lang: str = "EN"
    addcol_delimiter: str = texts.ADDCOL_DELIMITER
    mode: str = "plain"
    flag_prefix: bool = False
    rows_per_salt: int | None = None
    packed: bool = True

    def __post_init__(self):
        if self.lang not in texts.LANGUAGES:
            raise ValueError(f"lang must be one of {texts.LANGUAGES}, got {self.lang!r}")
        if self.mode not in ("plain", "generator"):
            raise ValueError(f"mode must be 'plain' or 'generator', got {self.mode!r}")
        if self.flag_prefix and not self.generator:
            raise ValueError("flag_prefix shows generator flags and needs mode='generator'")

    @property
    def generator(self) -> bool:
        return self.mode == "generator"


class Subscriptions:
    """Subscriptions salted by source table, with the partner side to match."""

    def __init__(self, snapshot: Snapshot, options: Options, hot: DataFrame | None = None):
        self.hot = hot_keys(snapshot.subs, _TABLE, options.rows_per_salt) if hot is None else hot
        self.rows = add_salt(snapshot.subs, self.hot)

    def partners(self, df: DataFrame) -> DataFrame:
        return copy_per_salt(df, self.hot)

    def tables(self, tables: DataFrame) -> DataFrame:
        """Distinct keys of ``tables``: copies are combined before the shuffle of the join."""
        return self.partners(tables.select(_TABLE)).distinct()


def source_table_not_found(snapshot: Snapshot, options: Options = Options()) -> DataFrame:
    """C-TNF: subscriptions whose source table is not in the catalogue.

    Subscriptions without a matching send queue are not reported.
    """
    return with_texts(vanished_tables(snapshot, options), options)


def vanished_tables(snapshot: Snapshot, options: Options) -> DataFrame:
    subs = Subscriptions(snapshot, options)
    orphans = subs.rows.join(subs.tables(snapshot.tables), [*_TABLE, SALT], "left_anti")
    return _drift(_with_queue(orphans, snapshot, options, "inner"), [_table_gone()], options)


def data_capture_missing(snapshot: Snapshot, options: Options = Options()) -> DataFrame:
    """C-DCC: subscribed tables whose capture flag is set to something other than 'Y'.

    A NULL flag is not reported.
    """
    return with_texts(unflagged_tables(snapshot, options), options)


def unflagged_tables(snapshot: Snapshot, options: Options) -> DataFrame:
    subs = Subscriptions(snapshot, options)
    unflagged = subs.tables(snapshot.unflagged_tables())
    return _drift(subs.rows.join(unflagged, [*_TABLE, SALT], "left_semi"), [_capture_off()], options)


def table_drift(snapshot: Snapshot, options: Options = Options()) -> DataFrame:
    """C-TNF and C-DCC from one join of subscriptions and tables, before texts."""
    subs = Subscriptions(snapshot, options)
    status = (
        subs.partners(snapshot.tables)
        .groupBy(*_TABLE, SALT)
        .agg(F.bool_or(F.col("data_capture") != "Y").alias("_off"))
        .withColumn("_known", F.lit(True))
    )
    gone = F.col("_known").isNull()
    drifted = subs.rows.join(status, [*_TABLE, SALT], "left").where(gone | F.col("_off"))
    queued = _with_queue(drifted, snapshot, options, "left", only=gone).where(~gone | F.col("_queued"))
    return _drift(queued, [_table_gone(when=gone), _capture_off()], options)


def subscribed_column_missing(snapshot: Snapshot, options: Options = Options()) -> DataFrame:
    """C-CNF: subscribed columns that are not in the catalogue although their table is."""
    return with_texts(missing_columns(snapshot, options), options)


def missing_columns(snapshot: Snapshot, options: Options) -> DataFrame:
    subs = Subscriptions(snapshot, options)
    if options.packed:
        return _drift(_compared(snapshot, subs, options, ("C-CNF",)), [_column_gone()], options)
    with_table = subs.rows.join(subs.tables(snapshot.tables), [*_TABLE, SALT], "left_semi")
    listed = snapshot.src_cols.join(with_table, _SUBSCRIPTION, "inner")
    missing = listed.join(
        subs.partners(snapshot.columns), [*_TABLE, "column_name", SALT], "left_anti"
    )
    return _drift(missing, [_column_gone()], options)


def column_not_subscribed(snapshot: Snapshot, options: Options = Options()) -> DataFrame:
    """C-CNS: catalogue columns of subscribed tables that the subscription does not list.

    In generator mode an unlisted column counts if the clause is silent, includes it,
    or does not exclude it. The clauses are joined last, to unlisted columns only.
    """
    return with_texts(unlisted_columns(snapshot, options), options)


def unlisted_columns(snapshot: Snapshot, options: Options) -> DataFrame:
    subs = Subscriptions(snapshot, options)
    if options.packed:
        unlisted = _compared(snapshot, subs, options, ("C-CNS",))
    else:
        # Every pair of a subscription and a column of its table is either a row of
        # ``src_cols`` or unlisted, so in plain mode the join makes no more rows than there
        # are listed columns and findings together.
        owned = subs.partners(snapshot.columns).join(subs.rows, [*_TABLE, SALT], "inner")
        unlisted = owned.join(snapshot.src_cols, [*_SUBSCRIPTION, "column_name"], "left_anti")
    if options.generator:
        unlisted = _with_clause(unlisted, subs, snapshot).where(_clause_reports())
    return _drift(unlisted, [_column_unlisted(options)], options)


def column_drift(snapshot: Snapshot, options: Options = Options()) -> DataFrame:
    """C-CNF and C-CNS from one comparison of catalogue and configuration, before texts."""
    subs = Subscriptions(snapshot, options)
    drift = (_compared if options.packed else _compared_by_row)(snapshot, subs, options)
    unlisted = F.col("_unlisted")
    if options.generator:
        # Only unlisted columns look for a clause; the target is needed for nothing else.
        drift = drift.withColumn("target_name", F.when(unlisted, F.col("target_name")))
        drift = _with_clause(drift, subs, snapshot).where(~unlisted | _clause_reports())
    return _drift(drift, [_column_unlisted(options, when=unlisted), _column_gone()], options)


def _kept(options: Options) -> list[str]:
    """What a finding about a column needs of its subscription."""
    return [*_SUBSCRIPTION, *_TABLE[1:], "state", "target_server", SALT, *(_TARGET if options.generator else [])]


def listing(snapshot: Snapshot, subs: Subscriptions, rows: DataFrame | None = None) -> DataFrame:
    """Every subscription (``rows``, if they have got further columns) with the set of the columns it lists."""
    # A column without a name equals no other, so it is noted beside the set.
    listed = (
        snapshot.with_copies("src_cols")
        .groupBy(*_SUBSCRIPTION)
        .agg(F.collect_set("column_name").alias("_listed"), F.bool_or(F.col("column_name").isNull()).alias("_listed_nameless"))
    )
    return (subs.rows if rows is None else rows).join(listed, _SUBSCRIPTION, "left")


def subscribed(snapshot: Snapshot, subs: Subscriptions, options: Options, queues: bool, by_clause: bool) -> DataFrame:
    """``listing`` with all that findings ask of a subscription: the map names of its queue
    (``_maps``; null without a queue) and the clauses of its target (``_clauses``; null
    without any). A subscription has very many findings, so it meets these before they are told."""
    rows = subs.rows
    if queues:
        hot = hot_keys(snapshot.subs, _QUEUE, options.rows_per_salt)
        maps = snapshot.sendqueues.groupBy(*_QUEUE).agg(F.collect_set(F.struct("pubqmapname")).alias("_maps"))
        keys = [*_QUEUE, _QUEUE_SALT]
        rows = add_salt(rows, hot, _QUEUE_SALT).join(copy_per_salt(maps, hot, _QUEUE_SALT), keys, "left").drop(_QUEUE_SALT)
    if by_clause:
        # No clause, a NULL and an empty one say the same.
        compacted = F.coalesce(clauses.compact(F.col("targetcolclause")), F.lit(""))
        held = snapshot.q_base.groupBy(*_INTENT).agg(F.collect_set(compacted).alias("_clauses"))
        rows = rows.join(subs.partners(held), [*_INTENT, SALT], "left")
    return listing(snapshot, subs, rows)


def catalogue(snapshot: Snapshot, subs: Subscriptions, tables: bool = True) -> DataFrame:
    """Every table with the set of its columns, whether the table list has it and its flag is off."""
    nothing = F.lit(None)
    columns = snapshot.with_copies("columns").select(
        *_TABLE, "column_name", F.col("column_name").isNull().alias("_nameless"), F.lit(False).alias("_known"), nothing.cast("boolean").alias("_off")
    )
    if tables:
        columns = columns.unionByName(
            snapshot.tables.select(
                *_TABLE,
                nothing.cast("string").alias("column_name"),
                F.lit(False).alias("_nameless"),
                F.lit(True).alias("_known"),
                (F.col("data_capture") != "Y").alias("_off"),
            )
        )
    flags = [F.bool_or(c).alias(c) for c in ("_nameless", "_known", "_off")]
    return subs.partners(columns).groupBy(*_TABLE, SALT).agg(F.collect_set("column_name").alias("_names"), *flags)


def _differences(met: DataFrame, kept: list[str], wanted: tuple[str, ...]) -> DataFrame:
    """A row per difference of the wanted checks: ``ordercol``, ``column_name`` and the kept columns.

    A subscription has met its listing and its table; only names that one of the two sets
    has alone become rows.
    """
    kind = "array<struct<ordercol:int,column_name:string>>"
    none, nameless = F.array().cast("array<string>"), F.array(F.lit(None).cast("string"))
    listed, names = F.coalesce("_listed", none), F.coalesce("_names", none)

    def named(check: str, columns: Column) -> Column:
        return F.transform(columns, lambda c: F.struct(F.lit(ORDER[check]).alias("ordercol"), c.alias("column_name")))

    known = F.coalesce("_known", F.lit(False))
    found = {
        "C-TNF": lambda: F.when(~known, named("C-TNF", nameless)),
        # Listed columns of a vanished table are left to C-TNF.
        "C-CNF": lambda: F.when(known, named("C-CNF", F.concat(F.array_except(listed, names), F.when(F.col("_listed_nameless"), nameless).otherwise(none)))),
        "C-CNS": lambda: named("C-CNS", F.concat(F.array_except(names, listed), F.when(F.col("_nameless"), nameless).otherwise(none))),
        "C-DCC": lambda: F.when(F.col("_off"), named("C-DCC", nameless)),
    }
    parts = [F.coalesce(found[check]().cast(kind), F.array().cast(kind)) for check in wanted]
    return met.select(*kept, F.inline(F.concat(*parts)))


def _compared(
    snapshot: Snapshot, subs: Subscriptions, options: Options, wanted: tuple[str, ...] = ("C-CNF", "C-CNS")
) -> DataFrame:
    """Columns that differ between catalogue and configuration, by sets of names."""
    met = listing(snapshot, subs).join(catalogue(snapshot, subs, tables="C-CNF" in wanted), [*_TABLE, SALT], "left")
    drift = _differences(met, _kept(options), wanted)
    return drift.withColumn("_unlisted", F.col("ordercol") == ORDER["C-CNS"]).drop("ordercol")


def all_drift(
    snapshot: Snapshot,
    options: Options,
    wanted: tuple[str, ...],
    subs: Subscriptions | None = None,
    met: DataFrame | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Any of the four checks from one meeting of subscriptions (see ``subscribed``) and catalogue,
    before texts: findings are told row by row then and cross no exchange. ``met`` is that meeting, if it is stored already; ``observation`` counts what it leaves
    out, see ``findings``."""
    subs = Subscriptions(snapshot, options) if subs is None else subs
    queues, by_clause = "C-TNF" in wanted, "C-CNS" in wanted and options.generator
    if by_clause:
        _check_q_base(snapshot)
    if met is None:
        met = subscribed(snapshot, subs, options, queues, by_clause).join(catalogue(snapshot, subs), [*_TABLE, SALT], "left")
    kept = [*_SUBSCRIPTION, *_TABLE[1:], "state", "target_server", *["_maps"] * queues, *["_clauses"] * by_clause]
    drift = _differences(met, kept, wanted)
    kinds = [_KINDS[list(ORDER).index(check)] for check in wanted]
    if queues:
        gone = F.col("ordercol") == ORDER["C-TNF"]
        queued = drift.select("*", F.explode_outer(F.when(gone, F.col("_maps"))).alias("_map"))
        if observation is not None:
            unreported = F.count_if(gone & F.col("_map").isNull()).alias("vanished_without_queue")
            queued = queued.observe(observation, unreported, F.count_if(gone & F.col("_map").isNotNull()).alias("vanished_with_queue"))
        drift = queued.where(~gone | F.col("_map").isNotNull()).withColumn("pubqmapname", F.col("_map.pubqmapname"))
    if by_clause:
        unlisted, none = F.col("ordercol") == ORDER["C-CNS"], F.array(F.lit(""))
        held = F.coalesce(F.when(unlisted, F.col("_clauses")), none)
        drift = _with_mentions(drift.select("*", F.explode(held).alias("_clause"))).where(~unlisted | _clause_reports())
    kinds = [replace(kind, when=F.col("ordercol") == ORDER[kind.check], has_clause=kind.has_clause and options.generator) for kind in kinds]
    return _drift(drift, kinds, options)


def _compared_by_row(snapshot: Snapshot, subs: Subscriptions, options: Options) -> DataFrame:
    """The same with a row per subscription and column.

    The columns each subscription should know (from the catalogue) and those it lists
    are put under each other and grouped per subscription and column; a group seen on
    one side only is drift. The grouping combines before it shuffles and keeps two
    flags per group, so neither copies nor hot tables burden it.
    """
    kept = _kept(options)
    rows = subs.rows.select(kept)
    known = subs.tables(snapshot.tables).withColumn("_known", F.lit(True))

    # The grouping takes copies up, so neither table is freed of them before its join.
    in_catalogue = subs.partners(snapshot.with_copies("columns")).join(rows, [*_TABLE, SALT], "inner")
    listed = snapshot.with_copies("src_cols").join(
        rows.join(known, [*_TABLE, SALT], "left"), _SUBSCRIPTION, "inner"
    )
    # A column without a name equals no other, so those of the two sides must not meet.
    sides = in_catalogue.select(
        *kept,
        "column_name",
        F.col("column_name").isNull().alias("_nameless"),
        F.lit(1).alias("_in_catalogue"),
        F.lit(0).alias("_listed"),
        F.lit(True).alias("_known"),
    ).unionByName(
        listed.select(
            *kept,
            "column_name",
            F.lit(False).alias("_nameless"),
            F.lit(0).alias("_in_catalogue"),
            F.lit(1).alias("_listed"),
            "_known",
        )
    )
    # Listed columns of a vanished table are left to C-TNF.
    return (
        sides.groupBy(*kept, "column_name", "_nameless")
        .agg(*[F.max(c).alias(c) for c in ("_in_catalogue", "_listed", "_known")])
        .where((F.col("_in_catalogue") != F.col("_listed")) & F.col("_known"))
        .withColumn("_unlisted", F.col("_in_catalogue") == 1)
    )


def _with_queue(
    subs: DataFrame, snapshot: Snapshot, options: Options, how: str, only: Column | None = None
) -> DataFrame:
    """Subscriptions with the map name of their send queue; many share one queue.

    In a left join only the rows of ``only`` look for their queue. The others get an
    empty key and, so that they do not all meet in one task, any salt.
    """
    hot = hot_keys(snapshot.subs, _QUEUE, options.rows_per_salt)
    queues = copy_per_salt(snapshot.sendqueues, hot, _QUEUE_SALT).withColumn("_queued", F.lit(True))
    salted = add_salt(subs, hot, _QUEUE_SALT)
    if only is not None:
        spread = F.hash(*_SUBSCRIPTION)
        salted = salted.withColumns(
            {
                "sendq": F.when(only, F.col("sendq")),
                _QUEUE_SALT: F.when(only, F.col(_QUEUE_SALT)).otherwise(spread),
            }
        )
    return salted.join(queues, [*_QUEUE, _QUEUE_SALT], how)


def _with_clause(unlisted: DataFrame, subs: Subscriptions, snapshot: Snapshot) -> DataFrame:
    """Adds the clause keyword and whether the clause includes or excludes the column."""
    _check_q_base(snapshot)
    compacted = snapshot.q_base.select(*_INTENT, clauses.compact(F.col("targetcolclause")).alias("_clause"))
    return _with_mentions(unlisted.join(subs.partners(compacted), [*_INTENT, SALT], "left"))


def _check_q_base(snapshot: Snapshot) -> None:
    if snapshot.q_base is None:
        raise ValueError("generator mode needs the q_base table")


def _with_mentions(unlisted: DataFrame) -> DataFrame:
    clause, column = F.col("_clause"), F.col("column_name")
    return unlisted.withColumns(
        {
            "_keyword": clauses.keyword(clause),
            "_included": clauses.mention_flag(clauses.INCLUDE_MARK, clause, column),
            "_excluded": clauses.mention_flag(clauses.EXCLUDE_MARK, clause, column),
        }
    )


def _clause_reports() -> Column:
    word = F.col("_keyword")
    return (
        word.isNull()
        | ((word == "INCLUDE") & (F.col("_included") == "Y"))
        | ((word == "EXCLUDE") & (F.col("_excluded") == "N"))
    )


@dataclass(frozen=True)
class _Kind:
    """One check: how its rows are told from those of others found with it (``when``), and
    what its findings show. ``catalogued`` tells whether the catalogue has the table or
    column; only then are its catalogue names shown."""

    check: str
    catalogued: bool
    has_column: bool
    has_clause: bool = False
    has_queue: bool = False
    when: Column | None = None


def _table_gone(when=None) -> _Kind:
    return _Kind("C-TNF", catalogued=False, has_column=False, has_queue=True, when=when)


def _column_gone() -> _Kind:
    return _Kind("C-CNF", catalogued=False, has_column=True)


def _column_unlisted(options: Options, when=None) -> _Kind:
    return _Kind("C-CNS", catalogued=True, has_column=True, has_clause=options.generator, when=when)


def _capture_off() -> _Kind:
    return _Kind("C-DCC", catalogued=True, has_column=False)


_KINDS = (_table_gone(), _column_gone(), _column_unlisted(Options(mode="generator")), _capture_off())
# What texts are made of. Findings are equal exactly if these are, see ``_drift``.
DRIFT = (
    "ordercol", SERVER, CAPTURE_SCHEMA, "subname", "target_server", "state", "source_owner", "source_name",
    "column_name", "pubqmapname", "_keyword", "_included", "_excluded",
)


def _drift(df: DataFrame, kinds: list[_Kind], options: Options) -> DataFrame:
    """Rows of the checks as the narrow columns ``DRIFT``; a row is of the first kind whose
    ``when`` holds.

    Findings are distinct over what they show, so what two equal findings may differ in is
    made equal here: what only shows trimmed is trimmed, what a NULL elsewhere in its only
    text hides becomes NULL. Then the narrow rows are distinct exactly where the findings are.
    """
    *first, last = kinds

    def of_kind(value) -> Column:
        out = value(last)
        for kind in reversed(first):
            out = F.when(kind.when, value(kind)).otherwise(out)
        return out

    nothing = F.lit(None).cast(T.StringType())

    def shown(name: str, has: str, value: Column | None = None) -> Column:
        if not any(getattr(k, has) for k in kinds):
            return nothing.alias(name)
        value = F.col(name) if value is None else value
        return of_kind(lambda kind: value if getattr(kind, has) else nothing).alias(name)

    complete = F.lit(True)
    for name in ("subname", "state", "source_owner", "source_name", "column_name"):
        complete &= F.col(name).isNotNull()
    clause = {c: F.when(complete, F.col(c)) if c == "_keyword" or options.flag_prefix else nothing for c in DRIFT[-3:]}
    return df.select(
        of_kind(lambda kind: F.lit(ORDER[kind.check])).alias("ordercol"),
        SERVER,
        F.trim(CAPTURE_SCHEMA).alias(CAPTURE_SCHEMA),
        *[F.col(c) for c in ("subname", "target_server", "state", "source_owner", "source_name")],
        shown("column_name", "has_column", _shown_column() if any(k.has_column for k in kinds) else nothing),
        shown("pubqmapname", "has_queue", F.when(F.col("subname").isNotNull(), F.col("pubqmapname")) if any(k.has_queue for k in kinds) else nothing),
        *[shown(c, "has_clause", clause[c]) for c in DRIFT[-3:]],
    )


def _shown_column() -> Column:
    """A column name as far as it shows: whole in the texts, without blanks around, and its first
    characters as they are. Without the name of its subscription no text shows it."""
    start, rest = F.substring("column_name", 1, DEBUG_WIDTH), F.substring("column_name", DEBUG_WIDTH + 1, 1 << 30)
    whole = F.when(F.trim(start) == "", F.concat(start, F.ltrim(rest))).otherwise(F.col("column_name"))
    return F.when(F.col("subname").isNull(), start).otherwise(whole)


def with_texts(drift: DataFrame, options: Options) -> DataFrame:
    """The fifteen finding columns of narrow rows."""
    shared = {
        "ordercol": F.col("ordercol"),
        "program": texts.program_name(F.col(CAPTURE_SCHEMA)),
        "current_server": F.col(SERVER),
        **{c: F.col(c) for c in ("subname", "target_server", "state", "source_owner", "source_name")},
    }
    own = [_own_columns(kind, options) for kind in _KINDS]

    def value(name: str) -> Column:
        if name in shared:
            return shared[name]
        out = F.lit(None)
        for kind, columns in zip(reversed(_KINDS), reversed(own)):
            out = F.when(F.col("ordercol") == ORDER[kind.check], columns[name]).otherwise(out)
        return out

    return drift.select([value(f.name).cast(f.dataType).alias(f.name) for f in FINDINGS])


def _own_columns(kind: _Kind, options: Options) -> dict[str, Column]:
    nothing = F.lit(None).cast(T.StringType())
    clause = prefix = None
    if kind.has_clause and options.generator:
        clause = texts.clause_note(F.col("_keyword"), options.lang)
        if options.flag_prefix:
            prefix = F.concat(*[F.coalesce(c, F.lit("")) for c in DRIFT[-3:]])
    text = texts.message(kind.check, options.lang, clause)
    active = F.when(F.col("state") == "A", "ERROR").otherwise("WARNING")
    return {
        "mtyp": F.lit(kind.check),
        "sev": active if kind.check == "C-TNF" else F.lit("ERROR"),
        "mtxt": text if prefix is None else F.concat(prefix, text),
        "fixit": texts.repair(kind.check, options.addcol_delimiter),
        "tbcreator": F.substring("source_owner", 1, DEBUG_WIDTH) if kind.catalogued else nothing,
        "tbname": F.substring("source_name", 1, DEBUG_WIDTH) if kind.catalogued else nothing,
        "colname": F.substring("column_name", 1, DEBUG_WIDTH) if kind.has_column else nothing,
    }
