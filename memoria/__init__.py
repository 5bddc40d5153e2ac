"""Retrieval and conversation analytics as DataFrame -> DataFrame functions."""
