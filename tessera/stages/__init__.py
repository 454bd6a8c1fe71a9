"""The stages that make a world, each a function from a world of DataFrames to one with more columns or tables."""
