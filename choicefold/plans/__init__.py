"""Estimation plans: the master program, row generation, bootstrap, refits."""
