"""Parsers of notes in Markdown: chunks, headings, links, blocks. Pure functions, and the same over tables."""
