"""All registered queries."""

from __future__ import annotations

from . import aggregates, boxes, changes, ordered, pipelines, processors, records, relational, reports, scalars, spatial  # noqa: F401
from .registry import ORACLE, PARTS, QUERIES  # noqa: F401
