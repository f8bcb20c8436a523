"""Text units, annotator spans and agreement tiers as Spark DataFrames."""
