"""Queries over the tables of a directory, each with its SQL where SQL can say it."""
