"""Whole workflows put together from operators."""
