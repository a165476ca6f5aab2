"""Operators for large text and key collections; nothing outside this subpackage imports it."""
