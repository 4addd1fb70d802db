"""Analytics over large bodies of technical documents, on Spark DataFrames."""
