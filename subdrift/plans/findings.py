"""All four checks together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation

from subdrift.operators import checks as of
from subdrift.operators.checks import Options
from subdrift.plans.prepared import Prepared
from subdrift.sources import Snapshot

CHECKS = {
    "C-TNF": of.source_table_not_found,
    "C-CNF": of.subscribed_column_missing,
    "C-CNS": of.column_not_subscribed,
    "C-DCC": of.data_capture_missing,
}
# The same before texts, alone and as pairs over the same inputs, answered in one pass.
_DRIFT = {
    "C-TNF": of.vanished_tables,
    "C-CNF": of.missing_columns,
    "C-CNS": of.unlisted_columns,
    "C-DCC": of.unflagged_tables,
}
PASSES = {("C-TNF", "C-DCC"): of.table_drift, ("C-CNF", "C-CNS"): of.column_drift}


def findings(
    snapshot: Snapshot | Prepared,
    options: Options = Options(),
    checks: tuple[str, ...] = tuple(CHECKS),
    observation: Observation | None = None,
) -> DataFrame:
    """Distinct union of the chosen checks over all fifteen columns.

    Rows are made distinct before the report drops columns, so a report may still
    show equal rows. Only what the texts are made of is shuffled here, neither the inputs
    nor the texts. ``prepare`` stores a snapshot so that not even the inputs are shuffled.

    Subscriptions of vanished tables are reported only with a send queue. An ``observation``
    (with C-TNF, packed) tells, once the job has run, how many rows were left out for want of
    one (``vanished_without_queue``) and how many were not (``vanished_with_queue``), in the same pass.
    """
    wanted = tuple(c for c in CHECKS if c in checks)
    if observation is not None and not ("C-TNF" in wanted and options.packed):
        raise ValueError("only C-TNF, with packed columns, has something to observe")
    if isinstance(snapshot, Prepared):
        drift = snapshot.drift(options, wanted, observation)
    elif options.packed and (observation is not None or not any(set(wanted) <= set(pair) for pair in PASSES)):
        drift = of.all_drift(snapshot, options, wanted, observation=observation)
    else:
        plans = []
        for pair, both in PASSES.items():
            of_pair = [c for c in pair if c in wanted]
            plans += [both] if len(of_pair) == 2 else [_DRIFT[c] for c in of_pair]
        drift = reduce(DataFrame.unionByName, [plan(snapshot, options) for plan in plans])
    return of.with_texts(drift.distinct(), options)
