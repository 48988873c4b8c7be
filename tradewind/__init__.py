"""Commerce analytics on Spark: raw CSV to KPI marts, and analytics over the result."""
