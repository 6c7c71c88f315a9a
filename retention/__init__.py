"""Spark-native subscriber churn analytics.

Every operator takes and returns DataFrames; rules are functions that return
``Column`` expressions, so a whole job compiles into one Catalyst plan.
"""

__version__ = "0.1.0"
