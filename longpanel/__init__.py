"""Panel analytics on PySpark: history features, balanced errors, slopes, resampling and null models."""
