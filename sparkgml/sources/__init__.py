"""Sources: files, archives, encodings, splitting, data sources, WFS."""
