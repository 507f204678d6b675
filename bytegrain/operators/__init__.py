"""Operators over entries: signals, decisions, blocks, codec, archives, verification, reports."""
