"""Feed files, tables, seeds and adapter views."""
