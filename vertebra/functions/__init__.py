"""Values and their text: the dynamic value type, and how vertices, edges, dictionaries and adjacency print."""
