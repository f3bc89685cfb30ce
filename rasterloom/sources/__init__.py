"""Sources and sinks: tile relations, images, SVG documents, label tables."""
