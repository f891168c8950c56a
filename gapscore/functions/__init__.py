"""Column functions: DataFrame expressions without state."""
