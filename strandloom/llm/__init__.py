"""Operators for training data: problems 2, 4, 5, 6, 7 and 8. Nothing else in the library imports them."""
