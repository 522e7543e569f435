"""Training-data operators: one module each, plus queries.py which registers them."""
