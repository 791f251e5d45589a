"""webloom: analytics over captured web pages and text corpora, built on PySpark DataFrames."""
