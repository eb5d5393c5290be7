"""tidemark: a Spark-native engine for code graphs, ranked text and bi-temporal evidence.

Every operator is a function from DataFrames to a DataFrame.  Nothing here holds data on the driver; where a
loop is needed only its counters come back.
"""

__version__ = "0.1.0"
