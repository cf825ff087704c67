"""Reading, generating and encoding tables."""
