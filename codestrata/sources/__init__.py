"""Readers that turn source trees into entity, relationship and alias rows."""
