"""Evidence retrieval, selection and evaluation over claim and report collections, on Spark DataFrames."""
