"""Dataset preparation on Spark: profiling, cleaning, evaluation and run search as DataFrame plans."""
