"""laminar: page-layout analytics on PySpark DataFrames."""
