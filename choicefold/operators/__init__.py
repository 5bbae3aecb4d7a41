"""Relational operators over agents, cuts, duals and replications."""
