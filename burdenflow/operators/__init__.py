"""Table operators that every analysis shares: joins, reshaping, counting, ordering, draws."""
