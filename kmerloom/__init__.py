"""kmerloom: alignment-free analysis of symbolic sequences as Spark DataFrame operations."""
