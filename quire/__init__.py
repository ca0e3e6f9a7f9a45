"""Quire: batched visual and text retrieval over page-structured documents, on Spark DataFrames."""
