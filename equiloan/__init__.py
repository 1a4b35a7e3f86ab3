"""equiloan: fair-lending analytics on Spark DataFrames.

Prepare loan-application tables, measure group parity of outcomes and of
model decisions, mitigate bias (reweighing, distribution repair), train and
compare models with ``pyspark.ml``, and report the results as tables.
"""

__version__ = "0.1.0"
