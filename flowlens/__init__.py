"""flowlens: analytics on flow, event and log tables, written with Spark DataFrames."""
