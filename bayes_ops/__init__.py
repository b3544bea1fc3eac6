"""bayes_ops: Bayesian experiment analytics expressed as Spark DataFrame plans.

Every model depends on its data only through a few distributed aggregates
(sufficient statistics).  Each model is therefore one or two aggregation jobs
over the experiment table followed by closed-form or grid-quadrature
posterior maths written as Column expressions, so results are deterministic
and never pass row data through the driver.
"""

from bayes_ops.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
