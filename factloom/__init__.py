"""factloom: code-fact analytics on PySpark.

Files, symbols, references and dependencies of software projects as
DataFrames, and the questions asked of them as joins, aggregations, windows and
bounded graph rounds.
"""

__version__ = "0.1.0"
