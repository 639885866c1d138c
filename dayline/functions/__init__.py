"""Column functions of one curve, and small dense algebra."""
