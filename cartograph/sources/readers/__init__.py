"""Tolerant readers of structured text: each returns what it could read and says whether that is all."""
