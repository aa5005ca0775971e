"""The fluent interface and the registered queries."""
