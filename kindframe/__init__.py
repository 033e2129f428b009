"""kindframe: declarative queries over kinds of documents, compiled to DataFrame expressions."""
