"""leadlane: work-order lead-time and delay analytics as Spark DataFrame operators.

Every public operator is a pure ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, joins, aggregates and windows. Nothing in the hot path
runs Python per row.
"""

__version__ = "0.1.0"
