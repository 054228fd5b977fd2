"""loomlog: agent-session analytics as plain Spark DataFrames."""
