"""DataFrame -> DataFrame operators; no operator keeps state of its own."""
