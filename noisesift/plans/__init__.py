
from noisesift.plans.registry import ORACLES, QUERIES, load_all  # noqa: F401
