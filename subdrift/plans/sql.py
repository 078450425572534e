"""The checks as table functions of SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from subdrift.operators.checks import Options
from subdrift.plans.findings import CHECKS, findings
from subdrift.plans.prepared import Prepared
from subdrift.plans.report import report
from subdrift.sources import Snapshot


def register_functions(snapshot: Snapshot | Prepared, options: Options = Options(), check_ts: str | None = None) -> list[str]:
    """Registers temporary table functions over a snapshot and returns their names: one per check
    (``c_tnf``, ``c_cnf``, ``c_cns``, ``c_dcc``) with the finding columns, and ``drift_report`` with those of
    the view. Each takes the name of a server; without one, or with NULL, it gives all:

        SELECT mtxt, fixit FROM c_cns('SRV1') WHERE source_owner = 'OWN3'

    Nothing runs before a function is asked. The server and other conditions reach the
    scans as far as those of ``findings`` do. Registering again replaces the functions.
    """
    each = {check.lower().replace("-", "_"): findings(snapshot, options, (check,)) for check in CHECKS}
    each["drift_report"] = report(findings(snapshot, options), check_ts, view=True)
    for name, df in each.items():
        _register(name, df)
    return list(each)


def _register(name: str, df: DataFrame) -> None:
    # A view of its own, so that functions registered later do not change a query made before.
    view = f"subdrift_{name}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    df.sparkSession.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(of_server STRING DEFAULT NULL) RETURNS TABLE ({columns}) "
        f"RETURN SELECT * FROM {view} WHERE {name}.of_server IS NULL OR current_server = {name}.of_server"
    )
