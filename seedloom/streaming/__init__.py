"""Unbounded sources are not part of this library's scope; every operator is a batch DataFrame function."""
