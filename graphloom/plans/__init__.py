"""Table definitions: schemas, and the model that derives a code graph from star-schema tables."""
