"""Column expressions: text, timecodes and ordered-position helpers."""
