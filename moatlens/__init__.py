"""moatlens: company and competitor intelligence as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` built from built-in
Spark SQL expressions (higher-order array functions, windows, aggregates and
joins). Nothing leaves the JVM in the hot path.
"""

__version__ = "0.1.0"
