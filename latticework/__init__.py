"""A knowledge and impact analytics engine on Spark DataFrames."""
