"""Relational operators over event, evidence, claim and annotation tables."""
