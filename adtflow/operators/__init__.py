"""Pipeline stages on DataFrames."""
