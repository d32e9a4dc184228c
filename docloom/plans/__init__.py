"""End-to-end plans (compositions of operators) and the query registry."""
