"""DataFrame operators of the record store and its retrieval and reporting dataflows."""
