"""Recommends settings for databases, JVMs, kernels, containers, applications and Spark sessions."""

from rootflow.advisor.rules import System, Workload, advise, compare, workload_from_logs, workload_from_metrics  # noqa: F401
