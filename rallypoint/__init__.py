"""Team-versus-team match analytics on Spark DataFrames."""
