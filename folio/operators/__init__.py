"""Operators on the relations of a document: selection, lookup, layout, tables, edits, comparison and gate rules."""
