"""Training-data operators: ten dealt components, their queries and their SQL."""
