"""Where graphs come from: source trees, their symbols, and ordinary tables."""
