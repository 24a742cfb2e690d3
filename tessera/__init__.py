"""tessera: candidate ranking, text statistics and link-graph analytics on Spark."""
