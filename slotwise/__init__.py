"""slotwise — appointment-scheduling analytics as Spark DataFrame operators.

Every operator is a plain function from DataFrames (plus explicit parameters
such as ``as_of``) to a DataFrame.  Nothing is collected to the driver; the
work is planned by Catalyst and executed by Spark.
"""

__version__ = "0.1.0"
