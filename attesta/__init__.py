"""Attesta: verifiable text retrieval and corpus operators on Spark."""
