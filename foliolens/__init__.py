"""foliolens: document reading and analytics as ordinary Spark DataFrames."""
