"""Reading and writing maps: tables, messages, JSON and binary files."""
