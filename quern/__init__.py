"""Association-rule analytics over labelled transactions, on Spark DataFrames."""
