"""Operators for preparing training data. Nothing outside this folder imports it.

Each module holds one operator; ``queries`` applies all of them to whole tables.
"""
