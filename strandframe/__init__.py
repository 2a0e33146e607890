"""Analytics operators over Spark DataFrames for protein, gene-neighbourhood and text tables."""
