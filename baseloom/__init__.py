"""Column-pattern analytics over alignments, expressed as Spark DataFrames."""
