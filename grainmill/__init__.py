"""grainmill: corpus curation and preference-data preparation on Spark DataFrames."""
