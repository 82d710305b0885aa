"""Privacy analytics on PySpark: de-identification metrics as DataFrame and SQL plans."""
