"""Clinical cohort analytics on Spark."""
