"""Program-graph analytics on Spark."""
