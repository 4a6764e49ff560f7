"""Training-data operators: ten corpus-preparation steps and their queries.

Nothing outside this subpackage imports it; see ``registry`` for the queries.
"""
