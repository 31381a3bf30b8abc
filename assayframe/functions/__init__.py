"""Column helpers and the fixed values every operator shares."""
