"""Relational, spatial, lookup, graph and numeric operators over keyed tables."""
