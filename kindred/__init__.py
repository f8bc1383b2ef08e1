"""Entity resolution and explainable related-artist recommendation on Spark DataFrames."""
