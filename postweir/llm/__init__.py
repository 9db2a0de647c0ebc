"""Operators for preparing training text: formatting, de-duplication, extraction, filtering, packing and record files."""
