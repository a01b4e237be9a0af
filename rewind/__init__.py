"""Change-log analytics and transaction reversal on Spark DataFrames."""
