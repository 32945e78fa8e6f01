"""vellum: note analytics and hybrid retrieval on Spark DataFrames."""
