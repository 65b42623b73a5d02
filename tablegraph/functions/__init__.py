"""Column expressions: everything here stays inside generated code, without Python workers."""
