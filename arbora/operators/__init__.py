"""Relational operators over parsed source trees."""
