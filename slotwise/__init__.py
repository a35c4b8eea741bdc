"""slotwise: schedule analytics and data preparation on PySpark DataFrames."""
