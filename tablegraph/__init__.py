"""Turns batches of files into described tables and into graphs of rows, on Spark."""
