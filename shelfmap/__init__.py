"""shelfmap: similar-document analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (plus plain
parameters) built on Spark SQL, Spark ML and Structured Streaming.
"""

__version__ = "0.1.0"
