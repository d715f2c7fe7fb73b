"""Choices that keep a plan balanced: hot keys and size checks."""
