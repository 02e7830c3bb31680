"""functions of the contract engine."""
