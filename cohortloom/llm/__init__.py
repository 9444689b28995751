"""Operators for free text, vectors and nearest-time matching; nothing outside this subpackage imports it."""
