"""Project-similarity and software-quality analytics on Spark."""
