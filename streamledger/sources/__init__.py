"""Tables read as logs, and the append-only store."""
