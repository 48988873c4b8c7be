"""Reading files, landing uploads, the load ledger and the table layers."""
