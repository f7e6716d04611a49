"""tabloom: tabular profiling, cleaning, feature engineering and model
evaluation expressed as Spark DataFrame jobs.

Every operator is a function ``f(DataFrame, ...) -> DataFrame`` built from
``pyspark.sql.functions`` and Spark ML, so Catalyst plans the work and the
cluster executes it. Driver-side code only ever sees small, size-bounded
summary tables (one row per column, per bucket or per model).
"""

__version__ = "0.1.0"
