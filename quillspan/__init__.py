"""Structural, link, terminology and prose analytics over Markdown corpora as Spark DataFrames."""
