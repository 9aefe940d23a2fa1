"""DataFrame operators: filters, aggregates, keyed operators, paging, contracts."""
