"""quillmark: document retrieval, provenance and training-data operators as Spark jobs.

Layout: ``sources`` reads tables and packages, ``functions`` holds column expressions, ``operators`` holds
DataFrame operators, ``plans`` the registered queries with their SQL, ``streaming`` the incremental jobs.
The optional subpackage ``llm`` holds operators on training text; nothing outside it imports it.
"""

__version__ = "0.1.0"
