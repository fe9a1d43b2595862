"""Co-barcode analytics on Spark DataFrames."""
