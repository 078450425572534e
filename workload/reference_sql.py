"""Plain SQL for every registered query, over the given tables only.

Written apart from the engine: texts are spelled out again, absence is tested with
NOT EXISTS, and everything runs over whole tables.
"""

from __future__ import annotations

from workload.inputs import AS_OF, CHECK_TS


def _inputs(fleet: bool, schema: str) -> str:
    # In a fleet the same names stand on three servers and under two capture schemas, and
    # up to four subscriptions share a table.
    if fleet:
        sub, tab, group, part = "o_orderkey // 6", "o_orderkey // 12", "o_orderkey // 12 % 25", "o_orderkey % 3"
        known = "({k} // 12 + {k} % 3) % 11 <> 3"
        server, named = "'SRV' || cast(o_orderkey % 3 AS varchar)", "'ASN' || cast(o_orderkey // 3 % 2 AS varchar)"
        queues = """
      SELECT 'SRV' || cast(f AS varchar) AS server, 'ASN' || cast(c AS varchar) AS schema,
             'SENDQ.' || cast(n_nationkey AS varchar) AS sendq,
             CASE WHEN n_nationkey = 7 THEN NULL ELSE n_name || cast(f AS varchar) || cast(c AS varchar) END AS qmap
      FROM nation, range(3) x(f), range(2) y(c) WHERE (n_nationkey + f + 2 * c) % 7 <> 0"""
    else:
        sub, tab, group, part = "o_orderkey", "o_orderkey", "o_custkey % 25", "o_custkey % 5"
        server, named, known = "'SRV0'", f"'{schema}'", "{k} % 11 <> 3"
        queues = f"""
      SELECT 'SRV0' AS server, '{schema}' AS schema, 'SENDQ.' || cast(n_nationkey AS varchar) AS sendq,
             CASE WHEN n_nationkey = 7 THEN NULL ELSE n_name END AS qmap
      FROM nation WHERE n_nationkey < 23"""
    return f"""
    o AS (
      SELECT o_orderkey AS k, o_orderstatus AS status, 'SUB' || cast({sub} AS varchar) AS subname,
             'T' || cast({tab} AS varchar) AS tab, cast({group} AS varchar) AS g, cast({part} AS varchar) AS f,
             {server} AS server, {named} AS schema
      FROM orders),
    subs AS (
      SELECT server, schema, subname, 'OWN' || g AS owner, tab, 'TGT' || g AS towner, tab AS ttab,
             CASE WHEN status = 'F' THEN 'A' WHEN status = 'O' THEN 'I'
                  WHEN k % 29 = 7 THEN NULL ELSE 'N' END AS state,
             'SENDQ.' || g AS sendq, 'TGTDB' || f AS tserver
      FROM o),
    queues AS ({queues}),
    cat_tables AS (
      SELECT server, 'OWN' || g AS owner, tab,
             CASE WHEN k % 13 = 5 THEN 'N' WHEN k % 17 = 4 THEN NULL ELSE 'Y' END AS flag
      FROM o WHERE {known.format(k="k")}),
    lines AS (
      SELECT l_orderkey AS lk, CASE WHEN l_linenumber = 7 THEN 'c7' ELSE 'C' || cast(l_linenumber AS varchar) END AS col,
             {known.format(k="l_orderkey")} AND (l_orderkey + l_linenumber) % 19 <> 0 AS in_catalogue,
             (l_orderkey * 3 + l_linenumber) % 23 <> 0 AS in_list
      FROM lineitem),
    cat_columns AS (
      SELECT DISTINCT o.server, 'OWN' || g AS owner, tab, col FROM o JOIN lines ON lk = k WHERE in_catalogue),
    listed AS (
      SELECT DISTINCT o.server, o.schema, subname, col FROM lines JOIN o ON lk = k WHERE in_list OR NOT in_catalogue),
    intents AS (
      SELECT server, schema, 'OWN' || g AS owner, tab, 'TGT' || g AS towner, tab AS ttab,
             replace(upper(CASE WHEN k % 8 = 0 THEN 'TRGCOLS EXCLUDE (C4) TRGCOLS INCLUDE (C2,C5)'
                                WHEN k % 16 = 4 THEN 'TRGCOLS' || chr(9) || 'INCLUDE (C1)'
                                WHEN k % 4 = 1 THEN 'TRGCOLS INCLUDE (C1, C2,C3,c7)'
                                WHEN k % 4 = 2 THEN 'trgcols exclude (c4,C5,c7)'
                                WHEN k % 4 = 3 THEN 'TRGCOLS ALL' END), ' ', '') AS clause
      FROM o WHERE k % 5 <> 0)"""


# Message texts, byte for byte.
_TEXTS = {
    "EN": {
        "tnf_kind": "' for source table '",
        "tnf_gone": "', exists, but the source table does not exist in DB2! '",
        "tnf_active": "'Deactivate and remove the subscription.'",
        "tnf_other": "'Remove the subscription.'",
        "cnf_kind": "' contains source column '",
        "cnf_gone": "' but the column does not exist in DB2!  Modify the subscription.'",
        "cns_kind": "' does not contain source col '",
        "cns_end": "'. Modify the subscription.'",
        "dcc_kind": "': Source table '",
        "dcc_end": "'does not have DATA CAPTURE flag. Alter the table.'",
        "with": "' with TRGCOLS '",
    },
    "DE": {
        "tnf_kind": "' fuer Quell-Tabelle '",
        "tnf_gone": "', existiert, aber die Tabelle exitiert nicht in DB2! '",
        "tnf_active": "'Deactiviere und entferne die Subscription.'",
        "tnf_other": "'Entferne die Subscription.'",
        "cnf_kind": "' enthaelt Quell-Spalte '",
        "cnf_gone": "' aber die Spalte existiert nicht in DB2!  Die Subscription ist anzupassen.'",
        "cns_kind": "' enthaelt die Quell-Spalte '",
        "cns_end": "' nicht. Die Subscription ist anzupassen.'",
        "dcc_kind": "': Quelltabelle '",
        "dcc_end": "'hat kein DATA CAPTURE Attribut. ALTER TABLE DATA CATRURE CHANGES ist auszufuehren.'",
        "with": "' mit TRGCOLS '",
    },
}


def _finding(order, check, sev, mtxt, fixit, shows_table, colname, source) -> str:
    creator = "left(s.owner, 18)" if shows_table else "cast(NULL AS varchar)"
    tbname = "left(s.tab, 18)" if shows_table else "cast(NULL AS varchar)"
    return f"""
      SELECT DISTINCT cast({order} AS integer) AS ordercol, 'ASNQCAP(' || s.schema || ')' AS program,
             s.server AS current_server, '{check}' AS mtyp, s.subname AS subname, {sev} AS sev,
             {mtxt} AS mtxt, {fixit} AS fixit, s.tserver AS target_server, s.state AS state,
             s.owner AS source_owner, s.tab AS source_name, {creator} AS tbcreator, {tbname} AS tbname,
             {colname} AS colname
      {source}"""


_HEAD = "'QSUB ' || s.subname || ' (' || s.state || ')'"
_TABLE = "s.owner || '.' || s.tab"
_TABLE_EXISTS = "EXISTS (SELECT 1 FROM cat_tables t WHERE (t.server, t.owner, t.tab) = (s.server, s.owner, s.tab))"


def _tnf(lang):
    t = _TEXTS[lang]
    return _finding(
        110,
        "C-TNF",
        "CASE s.state WHEN 'A' THEN 'ERROR' ELSE 'WARNING' END",
        f"{_HEAD} || {t['tnf_kind']} || {_TABLE} || ', STATE=' || s.state || {t['tnf_gone']}"
        f" || CASE s.state WHEN 'A' THEN {t['tnf_active']} ELSE {t['tnf_other']} END",
        "'DROP QSUB ( SUBNAME \"' || s.subname || '\"  USING REPLQMAP ' || q.qmap || ');'",
        False,
        "cast(NULL AS varchar)",
        f"FROM subs s JOIN queues q ON q.server = s.server AND q.schema = s.schema AND q.sendq = s.sendq WHERE NOT {_TABLE_EXISTS}",
    )


def _cnf(lang):
    t = _TEXTS[lang]
    return _finding(
        120,
        "C-CNF",
        "'ERROR'",
        f"{_HEAD} || {t['cnf_kind']} || {_TABLE} || '.' || l.col || {t['cnf_gone']}",
        f"'ALTER TABLE ' || {_TABLE} || ' ADD COLUMN ' || l.col || '<datatype>'",
        False,
        "left(l.col, 18)",
        f"""FROM subs s JOIN listed l ON l.server = s.server AND l.schema = s.schema AND l.subname = s.subname
      WHERE {_TABLE_EXISTS} AND NOT EXISTS (
        SELECT 1 FROM cat_columns c
        WHERE (c.server, c.owner, c.tab, c.col) = (s.server, s.owner, s.tab, l.col))""",
    )


def _cns(lang, generator=False, prefix=False, delimiter=";"):
    t = _TEXTS[lang]
    pieces, joins, rule = [_HEAD], "", ""
    if generator:
        pieces.append(f"CASE WHEN g.kw IS NULL THEN '' ELSE {t['with']} || g.kw END")
        joins = """LEFT JOIN (
        SELECT *, CASE WHEN contains(clause, 'TRGCOLSINCLUDE') THEN 'INCLUDE'
                       WHEN contains(clause, 'TRGCOLSEXCLUDE') THEN 'EXCLUDE' END AS kw
        FROM intents) g
        ON (g.server, g.schema, g.owner, g.tab, g.towner, g.ttab) = (s.server, s.schema, s.owner, s.tab, s.towner, s.ttab)"""
        named = "regexp_matches(g.clause, '[(,]' || regexp_escape(c.col) || '[),]')"
        rule = f"""AND CASE g.kw WHEN 'INCLUDE' THEN {named} WHEN 'EXCLUDE' THEN NOT {named} ELSE true END"""
    if prefix:
        flags = [
            f"CASE WHEN contains(g.clause, 'TRGCOLS{word}') AND {named} THEN 'Y' ELSE 'N' END"
            for word in ("INCLUDE", "EXCLUDE")
        ]
        pieces = ["coalesce(g.kw, '')", *flags, *pieces]
    return _finding(
        130,
        "C-CNS",
        "'ERROR'",
        f"{' || '.join(pieces)} || {t['cns_kind']} || {_TABLE} || '.' || c.col || {t['cns_end']}",
        # The repair statement, byte for byte.
        "'INSERT INTO IBMQREP_SIGNAL(SIGNAL_TIME, SIGNAL_TYPE, SIGNAL_SUBTYPE, SIGNAL_INPUT_IN, SIGNAL_STATE)"
        f" values (CURRENT TIMESTAMP, ''CMD'', ''ADDCOL'', ''' || s.subname || '{delimiter}' || c.col || ''', ''P'' );'",
        True,
        "left(c.col, 18)",
        f"""FROM subs s JOIN cat_columns c ON (c.server, c.owner, c.tab) = (s.server, s.owner, s.tab)
      {joins}
      WHERE NOT EXISTS (
        SELECT 1 FROM listed l WHERE (l.server, l.schema, l.subname, l.col) = (s.server, s.schema, s.subname, c.col)) {rule}""",
    )


def _dcc(lang):
    t = _TEXTS[lang]
    return _finding(
        140,
        "C-DCC",
        "'ERROR'",
        f"{_HEAD} || {t['dcc_kind']} || {_TABLE} || {t['dcc_end']}",
        f"'ALTER TABLE ' || {_TABLE} || ' DATA CAPTURE CHANGES;'",
        True,
        "cast(NULL AS varchar)",
        """FROM subs s WHERE EXISTS (
        SELECT 1 FROM cat_tables t
        WHERE (t.server, t.owner, t.tab) = (s.server, s.owner, s.tab) AND t.flag <> 'Y')""",
    )


def _check(body: str, fleet: bool = False, schema: str = "ASN") -> str:
    return f"WITH {_inputs(fleet, schema)} {body}"


def _all(lang="EN", generator=False, prefix=False, delimiter=";") -> str:
    return " UNION ALL ".join([_tnf(lang), _cnf(lang), _cns(lang, generator, prefix, delimiter), _dcc(lang)])


def _report(body: str, columns: str, fleet: bool = False, schema: str = "ASN") -> str:
    return f"""WITH {_inputs(fleet, schema)}, x AS ({body})
      SELECT {columns} FROM x"""


_REPORT_COLUMNS = f"""TIMESTAMP '{CHECK_TS}' AS check_ts,
      CASE WHEN length(program) > 18 THEN left(program, 16) || '..' ELSE program END AS program,
      current_server, mtyp, sev, mtxt, fixit"""
_VIEW_COLUMNS = f"ordercol, {_REPORT_COLUMNS}, target_server AS target_dbname, source_owner"
_DEBUG_COLUMNS = f"{_REPORT_COLUMNS}, state, subname, source_name, colname"


# Threshold tables ---------------------------------------------------------------

_PARMS = """
    parms AS (
      SELECT 'SRV' || cast(c_custkey AS varchar) AS server,
             CASE WHEN c_custkey % 7 <> 3 THEN 300 + c_custkey % 900 END AS alat_thresh_warning,
             CASE WHEN c_custkey % 11 <> 5 THEN 3000 + c_custkey % 4000 END AS alat_thresh_error,
             CASE WHEN c_custkey % 5 <> 2 THEN 50 + c_custkey % 500 END AS alat_cause_cap_qdepth,
             CASE WHEN c_custkey % 9 <> 1 THEN 40000 + c_custkey % 50000 END AS alat_cause_app_qdepth,
             CASE WHEN c_custkey % 6 <> 4 THEN 12 + c_custkey % 96 END AS exception_time_window,
             CASE WHEN c_custkey % 8 <> 6 THEN 5 + c_custkey % 720 END AS heartbeat_time_window,
             CASE WHEN c_custkey % 7 <> 3 THEN 200 + c_custkey % 900 END AS clat_thresh_warning,
             CASE WHEN c_custkey % 11 <> 5 THEN 3500 + c_custkey % 4000 END AS clat_thresh_error,
             CASE WHEN c_custkey % 3 <> 0 THEN 130000 END AS maxdepth_global
      FROM customer WHERE c_custkey % 13 <> 4)"""


def _effective(defaults: dict[str, int]) -> str:
    columns = ", ".join(f"cast(coalesce(p.{n}, {d}) AS integer) AS {n}" for n, d in defaults.items())
    return f"""WITH {_PARMS}
      SELECT s.server, {columns}
      FROM (SELECT 'SRV' || cast(c_custkey AS varchar) AS server FROM customer) s
      LEFT JOIN parms p ON p.server = s.server"""


_APPLY_DEFAULTS = {
    "alat_thresh_warning": 30,
    "alat_thresh_error": 600,
    "alat_cause_cap_qdepth": 100,
    "alat_cause_app_qdepth": 60000,
    "exception_time_window": 24,
    "heartbeat_time_window": 10,
    "maxdepth_global": 100000,
}
_CAPTURE_DEFAULTS = {"clat_thresh_warning": 300, "clat_thresh_error": 3600, "maxdepth_global": 100000}


def _violations(table: str) -> str:
    return f"""
      SELECT server, row_count,
             CASE row_count WHEN 0 THEN 'No row in table {table}'
                  ELSE 'No more than one row allowed in table {table}' END AS message
      FROM (
        SELECT 'SRV' || cast(c_custkey AS varchar) AS server,
               cast(CASE WHEN c_custkey % 13 = 4 THEN 0 WHEN c_custkey % 17 = 5 THEN 2 ELSE 1 END AS bigint)
                 AS row_count
        FROM customer)
      WHERE row_count <> 1"""


# Monitor ------------------------------------------------------------------------


def _samples(fleet: bool) -> str:
    server = "'SRV' || cast(user_id AS varchar)" if fleet else "'SRV0'"
    return f"""
    samples AS (
      SELECT {server} AS server, event_id AS sample_id, 'RECVQ.' || cast(user_id % 25 AS varchar) AS queue,
             ts AS sample_ts, value * 100 AS latency_s, event_id * 37 % 130001 AS qdepth, event_type AS kind
      FROM events)"""


_SAMPLE_COLUMNS = "m.server, m.sample_id, m.queue, m.sample_ts, m.latency_s, m.qdepth, m.kind"


def _limit(name: str, fleet: bool) -> str:
    shipped = {
        "alat_thresh_warning": 600,
        "alat_thresh_error": 3600,
        "alat_cause_cap_qdepth": 100,
        "alat_cause_app_qdepth": 60000,
        "exception_time_window": 24,
        "heartbeat_time_window": 10,
        "clat_thresh_warning": 500,
        "clat_thresh_error": 5400,
    }
    if not fleet:
        return str(shipped[name])
    return f"coalesce(p.{name}, {(_APPLY_DEFAULTS | _CAPTURE_DEFAULTS)[name]})"


def _monitor(columns: str, fleet: bool, tail: str = "") -> str:
    if not fleet:
        return f"WITH {_samples(fleet)} SELECT {columns} FROM samples m {tail}"
    return f"""WITH {_samples(fleet)}, {_PARMS}
      SELECT {columns} FROM samples m LEFT JOIN parms p ON p.server = m.server {tail}"""


def _severity(kind: str, fleet: bool) -> str:
    return f"""CASE WHEN m.latency_s > {_limit(kind + '_thresh_error', fleet)} THEN 'ERROR'
         WHEN m.latency_s > {_limit(kind + '_thresh_warning', fleet)} THEN 'WARNING'
         WHEN m.latency_s IS NOT NULL THEN 'OK' END"""


def _latency(kind: str, fleet: bool = False) -> str:
    return _monitor(f"{_SAMPLE_COLUMNS}, {_severity(kind, fleet)} AS sev", fleet)


def _cause(fleet: bool = False) -> str:
    late = f"m.latency_s > least({_limit('alat_thresh_error', fleet)}, {_limit('alat_thresh_warning', fleet)})"
    return _monitor(
        f"""{_SAMPLE_COLUMNS}, {_severity('alat', fleet)} AS sev,
        CASE WHEN {late} AND m.qdepth <= {_limit('alat_cause_cap_qdepth', fleet)} THEN 'CAPTURE'
             WHEN {late} AND m.qdepth >= {_limit('alat_cause_app_qdepth', fleet)} THEN 'APPLY' END AS cause""",
        fleet,
    )


def _since(name: str, unit: str, fleet: bool) -> str:
    return (
        f"m.sample_ts <= TIMESTAMP '{AS_OF}' AND "
        f"m.sample_ts > TIMESTAMP '{AS_OF}' - {unit}(cast({_limit(name, fleet)} AS integer))"
    )


def _exceptions(fleet: bool = False) -> str:
    return _monitor(
        _SAMPLE_COLUMNS, fleet, f"WHERE m.kind = 'error' AND {_since('exception_time_window', 'to_hours', fleet)}"
    )


def _heartbeats(fleet: bool = False) -> str:
    return _monitor(
        "m.server, m.queue, count(*) AS heartbeats, max(m.sample_ts) AS last_seen",
        fleet,
        f"""WHERE m.kind = 'view' AND {_since('heartbeat_time_window', 'to_minutes', fleet)}
        GROUP BY m.server, m.queue""",
    )


def _silent(fleet: bool = False) -> str:
    seen = f"m.kind = 'view' AND {_since('heartbeat_time_window', 'to_minutes', fleet)}"
    return _monitor(
        "m.server, m.queue", fleet, f"GROUP BY m.server, m.queue HAVING count(*) FILTER (WHERE {seen}) = 0"
    )


def _by_function() -> str:
    columns = "current_server, mtyp, sev, subname, mtxt, fixit"
    return f"""WITH {_inputs(True, "ASN")}, f AS ({_all(generator=True)})
      SELECT {columns} FROM f WHERE current_server = 'SRV1' AND mtyp = 'C-CNS' AND source_owner = 'OWN3'
      UNION ALL SELECT {columns} FROM f WHERE current_server = 'SRV2' AND mtyp = 'C-DCC'
      UNION ALL SELECT current_server, mtyp, sev, NULL AS subname, mtxt, fixit FROM f WHERE current_server = 'SRV0'"""


def _in_two_languages() -> str:
    return f"""WITH {_inputs(True, "ASN")}, en AS ({_all()}), de AS ({_all("DE")})
      SELECT 'EN' AS lang, {_REPORT_COLUMNS} FROM en UNION ALL SELECT 'DE' AS lang, {_REPORT_COLUMNS} FROM de"""


def oracle_sql() -> dict[str, str]:
    long_schema = "CAPTURESCHEM"
    return {
        "c_tnf": _check(_tnf("EN")),
        "c_cnf": _check(_cnf("EN")),
        "c_cns": _check(_cns("EN")),
        "c_cns_generator": _check(_cns("EN", generator=True)),
        "c_dcc": _check(_dcc("EN")),
        "c_dcc_host": _check(_dcc("EN")),
        "findings": _check(_all()),
        "findings_generator": _check(_all(generator=True)),
        "findings_fleet": _check(_all(), fleet=True),
        "findings_fleet_generator": _check(_all(generator=True), fleet=True),
        "findings_fleet_stored": _check(_all(generator=True), fleet=True),
        "findings_fleet_prepared": _check(_all(generator=True), fleet=True),
        "report": _report(_all(), _REPORT_COLUMNS),
        "report_de": _report(_all("DE"), _REPORT_COLUMNS),
        "report_de_generator": _report(_all("DE", generator=True), _REPORT_COLUMNS),
        "report_long_schema": _report(_all(), _REPORT_COLUMNS, schema=long_schema),
        "report_view": _report(_all(), _VIEW_COLUMNS),
        "report_debug": _report(_all(), _DEBUG_COLUMNS),
        "report_debug_generator": _report(_all(generator=True, prefix=True), _DEBUG_COLUMNS),
        "report_fleet": _report(_all(), _REPORT_COLUMNS, fleet=True),
        "report_delimiter": _report(_all(delimiter="#"), _REPORT_COLUMNS),
        "report_view_filtered": _report(_all(), _VIEW_COLUMNS, fleet=True) + " WHERE ordercol > 120 AND source_owner = 'OWN3'",
        "checks_by_function": _by_function(),
        "reports_stored": _in_two_languages(),
        "reports_prepared": _in_two_languages(),
        "parm_apply_effective": _effective(_APPLY_DEFAULTS),
        "parm_capture_effective": _effective(_CAPTURE_DEFAULTS),
        "parm_row_violations": _violations("QREP_MON_APPLY_PARM"),
        "parm_capture_row_violations": _violations("QREP_MON_CAPTURE_PARM"),
        "a_lat": _latency("alat"),
        "a_lat_cause": _cause(),
        "a_exc": _exceptions(),
        "a_chb": _heartbeats(),
        "a_chb_silent": _silent(),
        "c_lat": _latency("clat"),
        "a_lat_fleet": _latency("alat", fleet=True),
        "a_lat_cause_fleet": _cause(fleet=True),
        "a_exc_fleet": _exceptions(fleet=True),
        "a_chb_fleet": _heartbeats(fleet=True),
        "a_chb_silent_fleet": _silent(fleet=True),
        "c_lat_fleet": _latency("clat", fleet=True),
        "a_lat_cause_stream": _cause(fleet=True),
        "c_lat_stream": _latency("clat", fleet=True),
        "a_lat_cause_fleet_shuffled": _cause(fleet=True),
        "a_exc_fleet_shuffled": _exceptions(fleet=True),
        "c_lat_stream_shuffled": _latency("clat", fleet=True),
        "findings_salted": _check(_all(), fleet=True),
        "findings_generator_salted": _check(_all(generator=True), fleet=True),
    }
