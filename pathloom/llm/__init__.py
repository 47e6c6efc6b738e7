"""Operators for texts and learned matching. Nothing outside this subpackage imports it."""
