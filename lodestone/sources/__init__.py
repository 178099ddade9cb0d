"""Readers of benchmarks and concept lexicons."""
