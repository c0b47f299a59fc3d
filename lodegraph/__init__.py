"""lodegraph: symbol-graph analytics on Spark DataFrames.

The core package works on four tables (nodes, edges, refs, files); operators for training text
live in the optional subpackage ``lodegraph.llm``, which nothing else imports.
"""

__version__ = "0.1.0"
