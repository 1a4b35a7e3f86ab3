"""DataFrame operators of the fair-lending workflow."""
