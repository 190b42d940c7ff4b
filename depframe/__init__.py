"""depframe: program-dependence analytics and corpus preparation on PySpark."""
