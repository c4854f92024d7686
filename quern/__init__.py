"""quern: full-text indexing and ranked retrieval as Spark DataFrame plans."""
