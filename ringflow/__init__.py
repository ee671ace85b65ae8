"""ringflow: transaction-graph analytics on PySpark DataFrames."""
