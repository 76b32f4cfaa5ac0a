"""Evidence-fusion analytics on PySpark: DataFrame-in, DataFrame-out operators."""
