"""Readers of structures, templates, parameters and topologies."""
