"""Graph anonymisation and graph utility on PySpark DataFrames."""
