"""Market-risk analytics and corpus processing on PySpark DataFrames."""
