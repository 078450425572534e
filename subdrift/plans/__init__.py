"""Findings and reports built from the checks."""

from subdrift.plans.findings import CHECKS, findings
from subdrift.plans.prepared import Prepared, prepare
from subdrift.plans.report import create_report_view, report
from subdrift.plans.sql import register_functions

__all__ = ["CHECKS", "Prepared", "create_report_view", "findings", "prepare", "register_functions", "report"]
