"""Parametric DataFrame -> DataFrame operators."""
