"""DataFrame operators. Each takes key columns ``by`` and serves all keys at once."""
