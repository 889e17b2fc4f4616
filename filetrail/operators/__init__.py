"""Relational operators over files, evidence rows and sessions."""
