"""Post-sentiment analytics on Spark: land, clean, label, learn, score, store, report."""
