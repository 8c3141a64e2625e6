"""moltide: molecular-evidence analytics on PySpark DataFrames."""
