"""Molecule data work as Spark jobs."""
