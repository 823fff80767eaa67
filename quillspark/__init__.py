"""quillspark: document intelligence and research analytics on Spark DataFrames."""
