"""Data cleaning and training-data preparation on PySpark DataFrames."""
