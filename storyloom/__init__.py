"""Spark-native news intelligence: DataFrame operators over tables of articles, pages, quotes, filings and labels."""
