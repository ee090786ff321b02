"""quadstrata: a tiled, layered store of map objects on Spark."""
