"""Explains memory and time of a query, chooses join hints and sizes buffers, on the plan that Spark itself makes."""

from rootflow.planner.plan import Node, Report, choose_join, hinted, parse_size, plan_query  # noqa: F401
