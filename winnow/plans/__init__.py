"""Queries over the tables of a folder, with the SQL they are held against."""
