"""wideflow: wide-table cleaning, imputation, modelling and evaluation on Spark.

Every operator is a DataFrame -> DataFrame function (or a fit/transform pair
built on ``pyspark.ml``).  Operator ids in docstrings (``PRJ-1``, ``EVL-5``,
"""

__version__ = "0.1.0"
