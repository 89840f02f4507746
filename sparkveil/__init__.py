"""sparkveil: personal-data scanning, reversible masking and routing analytics on Spark DataFrames."""
