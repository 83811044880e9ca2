"""Readers: landed extracts, captured reply pages, spreadsheet files."""
