"""docloom: document analytics as DataFrame-to-DataFrame operators on Apache Spark."""
