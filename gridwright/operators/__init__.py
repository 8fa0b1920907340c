"""The cleaning tools. Each takes a grid, parameters and a mode, and returns a
ToolResult with a lazy grid.

Modes: ``literal`` keeps every rule as it is defined, odd ones included;
``intended`` does what such a rule is evidently meant to do.
"""

LITERAL, INTENDED = "literal", "intended"
