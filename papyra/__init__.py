"""papyra: document-corpus analytics as PySpark DataFrame operators.

Every operator takes and returns a DataFrame (or builds a Column); the heavy
lifting is left to Catalyst and the JVM.  Python runs inside tasks only for
text chunking and the optional embedding model, both over Arrow batches.
"""

__version__ = "0.1.0"
