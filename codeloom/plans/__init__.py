"""Plans of several operators: documentation structure, page contexts, diagrams and navigation."""
