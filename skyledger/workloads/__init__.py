"""Registered queries, one module per domain; importing this package registers them all."""

from skyledger.workloads import boxes, extra, files, geo, intake, labels, masks, reviews, sampling, scoring, tracks  # noqa: F401
from skyledger.workloads.registry import WORKLOADS

__all__ = ["WORKLOADS"]
