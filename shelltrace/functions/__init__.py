"""Column functions: text, terminal output and tool extractors."""
