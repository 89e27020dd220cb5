"""chatterscope: discussion analytics as Spark DataFrame operators."""
