"""arborlake: property-graph and text analytics expressed as Spark plans."""
