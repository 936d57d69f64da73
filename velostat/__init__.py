"""velostat: trip-record analytics as plain Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` and is
left to Catalyst to plan; nothing is collected to the driver.
"""

__version__ = "0.1.0"
