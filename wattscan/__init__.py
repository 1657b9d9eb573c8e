"""wattscan: energy-lint rules over a table of source files, as Spark plans."""
