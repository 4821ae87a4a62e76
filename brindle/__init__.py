"""brindle: a Spark-first analytics engine.

Everything is declared through the DataFrame and SQL API; Catalyst and AQE pick the physical
strategy. Python runs only in Arrow batches, where built-in expressions cannot say what is meant.
"""

__version__ = "0.1.0"
