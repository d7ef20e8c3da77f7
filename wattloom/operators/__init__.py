"""DataFrame -> DataFrame operators; every one takes many series at once."""
