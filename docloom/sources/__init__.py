"""Readers for corpora, instruction sets, prompt specs and the driver tables."""
