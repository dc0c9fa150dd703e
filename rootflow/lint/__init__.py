"""Reviews Python data code: memory-heavy patterns, and what keeps a PySpark job on the driver or in Python."""

from rootflow.lint.review import Finding, advised, report, review, review_file, selected  # noqa: F401
