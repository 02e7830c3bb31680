"""plans of the contract engine."""
