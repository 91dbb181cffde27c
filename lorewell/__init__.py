"""Set-at-a-time document-corpus analytics on Spark DataFrames."""
