"""From requests to Columns: selectors, index choice."""
