"""ledgerline: versioned key-value data as Spark relations."""
