"""shelfmark: document-registry analytics expressed as Spark DataFrame transformations.

Every operator is a function from DataFrames to DataFrames.  Nothing here keeps mutable state in the
session: a "mutation" returns the next version of a table, and the caller decides where to write it.
"""

__version__ = "0.1.0"
