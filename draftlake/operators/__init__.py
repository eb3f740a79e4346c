"""DataFrame operators grouped by the table family they work on."""
