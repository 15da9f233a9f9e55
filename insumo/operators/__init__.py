"""Operators of the catalogue engine: ``DataFrame -> DataFrame``, lazy, no actions."""
