"""evidex: document-to-event analytics expressed as Spark DataFrame operators."""
