"""Spark jobs that describe, check and decode collections of epoched signals."""
