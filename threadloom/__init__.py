"""Conversation and document evidence analytics as PySpark DataFrame operators."""
