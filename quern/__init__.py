"""A read-only entity query engine on Spark DataFrames."""
