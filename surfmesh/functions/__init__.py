"""Column-expression libraries: everything here plans inside whole-stage code generation."""
