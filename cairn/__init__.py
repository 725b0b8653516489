"""Evidence-based rule evaluation and corpus preparation on Spark DataFrames."""
