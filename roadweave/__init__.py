"""Road-network analytics on Spark: graph tables, costs, searches, matching and live traffic as DataFrame programs."""
