"""Document analytics on Spark: lines, objects, features, graphs, checks and text outputs as DataFrame jobs."""
