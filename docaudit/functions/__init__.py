"""Column functions: text normalisation, hashing, alt-quality classifiers."""
