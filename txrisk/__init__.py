"""txrisk: transaction-risk analytics as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function built from
DataFrame expressions, window functions and Spark ML pipelines.
"""

__version__ = "0.1.0"
