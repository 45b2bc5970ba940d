"""helioframe: solar sizing of roofs as Spark DataFrame operators."""
