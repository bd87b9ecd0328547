"""Operators for building text corpora. Nothing outside this subpackage imports it."""
