"""Readers and writers of the supported file layouts."""
