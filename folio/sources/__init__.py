"""Scans that turn raw text, HTML, Markdown, JSON logs and office packages into ordered records."""
