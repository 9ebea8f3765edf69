"""Distributed graph operators."""
