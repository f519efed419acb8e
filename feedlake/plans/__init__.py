"""The three runs (discover, sync, drain) composed from the operators."""
