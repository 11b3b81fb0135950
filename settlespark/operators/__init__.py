"""Set-based jobs over payments, ledger, settlements, payouts and cases."""
