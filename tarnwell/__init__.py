"""tarnwell: a site-content index and training-data operators on PySpark DataFrames."""
