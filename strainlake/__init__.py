"""strainlake: volumetric displacement analytics as DataFrame plans on Apache Spark."""
