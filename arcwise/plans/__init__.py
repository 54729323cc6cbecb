"""Whole plans: methods by name, learners, the command line, and the queries over the test tables."""
