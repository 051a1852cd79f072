"""Contact-template analytics on Spark."""
