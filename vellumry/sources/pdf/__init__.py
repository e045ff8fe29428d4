"""PDF: reader to glyph runs, and writer."""
