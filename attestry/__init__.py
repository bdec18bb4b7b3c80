"""Evidence analytics on PySpark: DataFrame-in, DataFrame-out operators for annotated document corpora."""
