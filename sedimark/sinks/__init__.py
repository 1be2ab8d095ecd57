"""Written forms of the ledger."""
