"""Training-data operators over document tables, their queries and their SQL."""
