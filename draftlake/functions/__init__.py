"""Column functions: no UDFs, everything stays inside whole-stage codegen."""
