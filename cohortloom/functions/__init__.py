"""Column functions and the fixed values they rely on."""
