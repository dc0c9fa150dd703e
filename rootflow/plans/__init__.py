"""Registered queries, grouped by theme; importing this package registers all of them."""

from rootflow.plans import models, more, relational, reports, workloads  # noqa: F401
