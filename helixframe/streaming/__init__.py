"""Nothing here yet: the operators of this engine work on bounded tables and have no stream semantics."""
