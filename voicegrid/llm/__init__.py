"""Training-data operators on large document tables.

Ten operators, each in a module of its own; ``queries`` registers them.
Nothing outside this subpackage imports it.
"""
