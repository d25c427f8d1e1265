"""newsmill: news-item analytics on PySpark DataFrames."""
