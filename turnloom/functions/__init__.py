"""Column functions over text, arrays, tokens and chat templates."""
