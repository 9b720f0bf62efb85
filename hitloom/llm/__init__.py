"""Operators for preparing text and media at corpus scale."""
