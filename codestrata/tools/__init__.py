"""The tool registry and the command line."""
