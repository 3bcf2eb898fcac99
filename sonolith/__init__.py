"""sonolith: signals, events and corpora as Spark DataFrames."""
