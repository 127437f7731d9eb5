"""Budget-variance analytics for monthly cost data, on PySpark DataFrames."""
