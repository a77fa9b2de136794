"""The silver and gold layers every operator builds on."""
