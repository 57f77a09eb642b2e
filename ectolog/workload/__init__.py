"""Registered queries over the test tables, each next to its SQL equivalent."""

from ectolog.workload import basic, composites, relational, statistics  # noqa: F401
from ectolog.workload.registry import ORACLES, QUERIES  # noqa: F401
