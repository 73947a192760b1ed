"""End-to-end plans over the generated tables, with their SQL counterparts."""
