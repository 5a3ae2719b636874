"""docquarry subpackage."""
