"""Edge, count, degree, path and triangle operators."""
