"""Training-data preparation: the ten operators and the queries that apply them."""
