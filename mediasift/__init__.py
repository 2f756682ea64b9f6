"""mediasift: near-duplicate detection, label checking and curation on Spark DataFrames."""
