"""scrubline: cleaning, profiling and summarising messy tables on Spark."""
