"""Part of driftloom; see the README for an overview."""
