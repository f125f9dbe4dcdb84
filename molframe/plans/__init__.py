"""Pipelines: structures, preparation, solvation, energies, optimisation, reports."""
