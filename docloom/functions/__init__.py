"""Column-expression helpers (JVM-side, codegen or built-in HOFs only)."""
