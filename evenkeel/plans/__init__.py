"""Cost models, repartition planning and planned execution."""
