"""Plans made of several operators, with model calls between them."""
