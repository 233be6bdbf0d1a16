"""Functions over values: lexical rules, geometry, coordinate reference systems, projections."""
