"""Spark-first analytics over labelled images, their measurements and cohorts."""
