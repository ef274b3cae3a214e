"""tracelore: analytics over agent-session logs and the memory distilled from them.

Every operator is a function from DataFrames to DataFrames. Whole tables go in,
whole results come out; projects, users and sessions are partition keys, never
loop variables.
"""

__version__ = "0.1.0"
