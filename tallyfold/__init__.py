"""Analytics on Spark DataFrames: numerical preparation, evaluation and learning, declared and left to Catalyst."""
