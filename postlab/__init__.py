"""postlab: classify and analyse large collections of short texts with PySpark."""
