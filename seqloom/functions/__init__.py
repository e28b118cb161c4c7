"""Scalar expressions; every one is a plain Column expression that stays inside code generation."""
