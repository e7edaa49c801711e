"""labelloom: weak labelling of web-text corpora on Spark DataFrames."""
