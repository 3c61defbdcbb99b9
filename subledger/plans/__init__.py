"""The whole flow, from raw sources to marts and checks, and the registered queries."""
