"""Operators that prepare data for training language models. Nothing outside this subpackage imports it."""
