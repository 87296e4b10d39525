"""pollspark: pooled opinion-survey analysis as Spark DataFrame plans."""
