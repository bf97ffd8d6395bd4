"""storyatlas: a Spark-first engine that turns collections of short texts into
located, filterable map data, with corpus-scale data preparation beside it."""
