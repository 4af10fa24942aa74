"""The registered queries. Importing the modules fills the registry."""

from signalbed.plans import anomaly, logs, metrics, parsing, retention, rules, traces
from signalbed.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES", "anomaly", "logs", "metrics", "parsing", "retention", "rules", "traces"]
