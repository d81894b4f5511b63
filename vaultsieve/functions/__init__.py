"""Part of the credential-leak analytics library."""
