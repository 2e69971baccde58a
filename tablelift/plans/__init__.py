"""Driver-side plan objects: expressions, approvals and limits. No data flows through them."""
