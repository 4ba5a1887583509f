"""Column builders shared by the sources and operators."""
