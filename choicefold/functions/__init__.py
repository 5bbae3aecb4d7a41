"""Column functions, parameter layout, random weights and bundle keys."""
