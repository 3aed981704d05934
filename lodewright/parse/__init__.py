"""Files to records and edges: chunks, definitions, sections, metadata."""
