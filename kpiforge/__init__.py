"""kpiforge: web-analytics, newsletter and account jobs as Spark DataFrame plans.

Every operator is a plain function from DataFrames (plus parameters) to a
DataFrame.  Nothing is collected inside an operator; time-relative operators
take an explicit ``as_of`` instead of reading the clock.
"""

__all__ = ["session", "schemas", "sources", "functions", "operators", "plans", "streaming"]
