"""Shared building blocks of the operators."""
