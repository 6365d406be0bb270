"""Column builders: spherical geometry, photometry and the scalar functions of the dialect."""
