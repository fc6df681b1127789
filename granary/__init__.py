"""granary: a PySpark-native engine for append-only memory data.

Every operator is a function from DataFrames to a DataFrame. See README.md for the map of modules.
"""

__version__ = "0.1.0"
