"""Tables that change, and the queries that the driver checks."""
