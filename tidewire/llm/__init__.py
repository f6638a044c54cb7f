"""Training-data operators: ten large-scale document operators and their registered queries."""
