"""budgetlens: budget analytics on Spark.

Every public operator is a pure ``DataFrame -> DataFrame`` function over named
columns. Fitted quantities (thresholds, deltas, edges) are small frozen
dataclasses computed by a Spark aggregation and applied as literals.
"""

__version__ = "0.1.0"
