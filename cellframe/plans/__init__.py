"""Query catalogue and pipeline of named operators."""
